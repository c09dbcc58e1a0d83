import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from ravelin.config import Config, Retrieval, bare_host, load, merged
from ravelin.operators.rerank import HashedEmbedder
from ravelin.plans.engine import HybridEngine
from ravelin.sources import events, files, suite
from ravelin.sources import extract as X
from ravelin.sources.store import ChunkStore
from ravelin.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
BODY = " ".join(f"This is sentence number {i:03d} of the body." for i in range(6))


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def word(*paragraphs):
    return f'<w:d xmlns:w="{W}" xmlns:o="urn:other">' + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r><o:t>ignored</o:t></w:p>" for p in paragraphs) + "</w:d>"


def slide(text):
    return f'<p:s xmlns:p="urn:p" xmlns:a="{A}"><a:p><a:t>{text}</a:t></a:p></p:s>'


def test_extractors():
    assert X.docx(archive({"word/document.xml": word("one", "two")})) == "one \n\ntwo \n\n"
    assert X.docx(archive({"word/document.xml": word("kept", "lost")[:-60]})).startswith("kept ")
    assert X.pptx(archive({"ppt/slides/slide1.xml": slide("a"), "ppt/slides/slide10.xml": slide("b"), "ppt/slides/slide2.xml": slide("c"), "ppt/other.xml": slide("x")})) == "a \n\n\n\nb \n\n\n\nc \n\n\n\n"
    for bad in (b"", b"no zip", archive({"else.xml": "x"})):
        with pytest.raises(ValueError):
            X.docx(bad)
    assert X.is_binary(b"\x00" * 60 + b"a" * 400) and not X.is_binary(b"text\n\t" * 100) and not X.is_binary(b"")
    with pytest.raises(ValueError):
        X.plain(b"\x01\x02" * 300)
    assert X.plain("é".encode() + b"\xff") == "é�"
    assert X.basename("/a/é.txt") == "é.txt"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")

    def put(name, data):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())

    put("a.txt", BODY)
    put("dir with space/a.txt", BODY)  # a copy under the same name
    put("dir with space/b+c.md", BODY.replace("body", "sheet"))
    put("doc.docx", archive({"word/document.xml": word(BODY, BODY)}))
    put("broken.docx", b"not a zip" * 30)
    put("binary.dat", b"\x00\x01" * 400)
    put("picture.png", BODY)
    put("~$x.docx", BODY)
    put(".hidden.md", BODY)
    put(".git/a.md", BODY)
    put("node_modules/a.md", BODY)
    put("Old stuff/skip.md", BODY)
    put("f49.txt", "x" * 49)
    put("f50.txt", "x" * 50)
    return root


SETTINGS = Retrieval(ignored_dirs=("old",))


def test_scan(spark, tree):
    found = {r["inside"] for r in files.scanned(spark, str(tree), SETTINGS).select("inside").collect()}
    assert found == {"a.txt", "dir with space/a.txt", "dir with space/b+c.md", "doc.docx", "broken.docx", "binary.dat", "f49.txt", "f50.txt"}


def test_texts_and_chunks(spark, tree):
    read = {r["path"].rsplit("/", 1)[-1]: r for r in files.texts(files.scanned(spark, str(tree), SETTINGS)).collect()}
    assert read["broken.docx"]["text"] is None and read["broken.docx"]["extract_error"]
    assert read["binary.dat"]["extract_error"] == "binary"
    cut = files.file_chunks(files.scanned(spark, str(tree), SETTINGS), SETTINGS)
    assert sorted((r["filename"], r["chunk_ord"]) for r in cut.collect()) == [("a.txt", 0), ("b+c.md", 0), ("doc.docx", 0)]


def test_engine(spark, tree, tmp_path):
    e = HybridEngine(spark, str(tmp_path / "store"), Config(retrieval=SETTINGS), embedder=HashedEmbedder(16))
    e.index(str(tree))
    e.index(str(tree))  # nothing is indexed twice
    s = e.stats().first()
    assert (s["chunks"], s["with_vector"], s["files"], s["vec_dim"]) == (3, 3, 3, 16)
    assert [r["filename"] for r in e.files().collect()] == ["a.txt", "b+c.md", "doc.docx"]
    q = spark.createDataFrame([(1, "SENTENCE number of the sheet ?"), (2, "bonjour")], "query_id int, q string")
    top = e.search(q).where("query_id = 1").orderBy("rank").collect()
    assert {r["filename"] for r in top} == {"a.txt", "b+c.md", "doc.docx"}
    said = {r["query_id"]: r for r in e.ask(q).collect()}
    assert said[1]["decision"] == "answer" and "QUESTION: SENTENCE number of the sheet" in said[1]["prompt"] and said[1]["included"] >= 2
    assert said[2]["decision"] == "small_talk" and said[2]["prompt"] is None
    e.clear()
    assert e.store.count() == 0 and e.search(q).count() == 0


def test_engine_without_models(spark, tmp_path):
    e = HybridEngine(spark, str(tmp_path / "store"))
    e.insert(spark.createDataFrame([("1", "alpha beta", "f"), ("2", None, None)], "id string, text string, filename string"))
    q = spark.createDataFrame([(1, "Alpha")], "query_id int, q string")
    assert [r["id"] for r in e.search(q).collect()] == ["1"]


def test_store_refuses_other_sizes(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "s"))
    row = lambda i, v: spark.createDataFrame([(i, "t", "f", v)], "id string, text string, filename string, embedding array<float>")
    s.insert(row("1", [1.0, 2.0]))
    s.insert(row("2", None))
    with pytest.raises(ValueError):
        s.insert(row("3", [1.0]))
    assert s.vec_dim() == 2 and s.count() == 2


def counting(path):
    """An embedder that notes each text it gets in a file, for it runs in other processes; it fails while `down` exists."""

    class Counting:
        def embed(self, texts):
            with open(f"{path}/asked", "a") as f:
                f.writelines("x\n" for _ in texts)
            if os.path.exists(f"{path}/down"):
                raise OSError("down")
            return [[float(len(t)), 1.0] for t in texts]

    return Counting()


def test_inserts_embed_once_and_refill(spark, tmp_path):
    asked = lambda: len(open(tmp_path / "asked").readlines()) if (tmp_path / "asked").exists() else 0  # noqa: E731, SIM115
    e = HybridEngine(spark, str(tmp_path / "store"), embedder=counting(str(tmp_path)))
    rows = spark.createDataFrame([(f"{k}", f"alpha text {k}", "f") for k in range(10)] + [("none", None, "f")], "id string, text string, filename string")
    assert e.insert(rows) == {"added": 11, "refilled": 0, "without_vector": 0} and asked() == 10
    assert e.insert(rows.unionByName(rows)) == {"added": 0, "refilled": 0, "without_vector": 0} and asked() == 10
    (tmp_path / "down").touch()
    more = spark.createDataFrame([(f"m{k}", f"beta {k}", "g") for k in range(3)], "id string, text string, filename string")
    assert e.insert(more)["without_vector"] == 3 and asked() == 13
    (tmp_path / "down").unlink()
    assert e.insert(more.unionByName(rows)) == {"added": 0, "refilled": 3, "without_vector": 0} and asked() == 16
    assert e.insert(more)["refilled"] == 0 and asked() == 16
    s = e.stats().first()
    assert (s["chunks"], s["with_vector"], s["vec_dim"]) == (14, 13, 2)
    before = sorted(map(tuple, e.store.text_index().postings.collect()))
    e.store.compact()
    assert sorted(map(tuple, e.store.text_index().postings.collect())) == before and e.stats().first() == s and not e.store._exists("refills")
    (tmp_path / "store" / "_inserting").touch()  # an insert that broke off
    assert e.store.text_index() is None
    e.insert(rows)
    assert sorted(map(tuple, e.store.text_index().postings.collect())) == before


def test_search_by_cells(spark, tmp_path):
    e = HybridEngine(spark, str(tmp_path / "store"), Config(retrieval=Retrieval(approximate=True, ann_threshold=5)), embedder=HashedEmbedder(8))
    e.insert(spark.createDataFrame([(f"{k:02d}", f"word{k} and word{k + 1}", "f") for k in range(30)], "id string, text string, filename string"))
    assert e._cells() is None
    e.index_vectors()
    q = spark.createDataFrame([(1, "word3 word4 ?")], "query_id int, q string")
    assert e._cells() is not None and "03" in {r["id"] for r in e.search(q).collect()}


def test_answers(spark, tmp_path):
    class Echo:
        def generate(self, prompts):
            return [f"{len(p)} signs" for p in prompts]

    e = HybridEngine(spark, str(tmp_path / "store"))
    e.insert(spark.createDataFrame([("1", "alpha beta", "f")], "id string, text string, filename string"))
    got = {r["query_id"]: r for r in e.answer(spark.createDataFrame([(1, "Alpha"), (2, "bonjour")], "query_id int, q string"), Echo()).collect()}
    assert got[1]["answer"].endswith("signs") and got[2]["answer"] is None and got[2]["decision"] == "small_talk"


def test_reranker(spark):
    from ravelin.operators.rerank import reranked

    class Length:
        def score(self, pairs):
            return [float(len(t)) for _, t in pairs]

    class Broken:
        def score(self, pairs):
            raise OSError("down")

    rows = spark.createDataFrame([(1, "q", "a", "xxx", 0.5), (1, "q", "b", "x", 0.9)], "query_id int, q string, id string, text string, score double")
    assert {r["id"]: r["score"] for r in reranked(rows, Length()).collect()} == {"a": 1.0, "b": 0.0}
    for none in (None, Broken()):
        assert {r["id"]: r["score"] for r in reranked(rows, none).collect()} == {"a": 0.5, "b": 0.9}


def test_config(tmp_path):
    assert bare_host("https://host.example:80") == "host.example"
    c = load((str(tmp_path / "none.yaml"),), {"OLLAMA_HOST": "http://h:1", "OLLAMA_PORT": "12"})
    assert (c.model.host, c.model.port) == ("h", 12)
    assert load((), {"OLLAMA_PORT": "x"}).model.port == 11434
    m = merged(Config(), "rag: {min_score: 0.0, max_per_file: 0, rerank_pool: 5, hnsw_threshold: 7, unknown: 1}\nsearch_rules: {technical_terms: [a, b], stop_words: []}")
    assert (m.retrieval.min_score, m.retrieval.max_per_file, m.retrieval.rerank_pool, m.retrieval.ann_threshold, m.retrieval.technical_terms) == (0.0, 2, 5, 7, ("a", "b"))
    assert len(m.retrieval.stop_words) > 40
    assert merged(Config(), "rag: [") == Config()


def test_suite(spark, tmp_path):
    p = tmp_path / "t.yaml"
    p.write_text("- {category: A, question: q, keywords: [k]}\n- {category: B, type: trap, question: r}\n")
    rows = suite.load_suite(spark, str(p)).orderBy("test_id").collect()
    assert [(r["test_id"], r["type"], r["keywords"], r["sources"]) for r in rows] == [(1, "normal", ["k"], []), (2, "trap", [], [])]
    assert "désolé" in rows[1]["refusal_patterns"]


LINES = ['data: {"type":"token","text":"a"}', "event: x", "data: not json", 'data: {"type":"sources","sources":[{"filename":"f","score":0.12345,"text":"t"}],"metrics":{"search_time":"12ms","gen_time":"1,5s","total_time":null}}', "data: [DONE]"]


def test_events(spark):
    rows = spark.createDataFrame([(1, k, line) for k, line in enumerate(LINES)], "req_id int, seq int, value string")
    got = events.parsed(rows).orderBy("seq").collect()
    assert [r["type"] for r in got] == ["token", "sources", "[DONE]"]
    timed = events.parsed(rows).withColumns({"emitted_at": F.current_timestamp(), "arrived_at": F.current_timestamp()})
    a = events.answers(timed.unionByName(timed)).first()
    assert (a["answer"], a["tokens"], a["complete"], a["search_ms"], a["gen_s"], a["total_s"], a["fallback"]) == ("a", 1, True, 12, 1.5, 0.0, False)
    assert events.source_scores(timed).first()["score"] == 0.123


def test_streams(spark, tree, tmp_path):
    e = HybridEngine(spark, str(tmp_path / "store"), Config(retrieval=SETTINGS))
    for _ in range(2):  # the second run finds nothing new
        ingest.index_stream(e, str(tree), str(tmp_path / "cp"), once=True).awaitTermination(120)
        assert e.store.count() == 3


def test_answer_stream(spark, tmp_path):
    rows = [(1, 0, "token", "b", "2025-01-01 00:00:01"), (1, 1, "token", "c", "2025-01-01 00:00:02"), (1, 1, "token", "c", "2025-01-01 00:00:02"), (1, 2, "[DONE]", None, "2025-01-01 00:00:03"), (2, 0, "token", "z", "2025-01-02 00:00:00")]
    schema = "req_id int, seq int, type string, text string, at string"
    df = spark.createDataFrame(rows, schema).select("req_id", "seq", "type", "text", F.to_timestamp("at").alias("emitted_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ingest.answer_stream(stream).writeStream.format("memory").queryName("answers_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [tuple(r) for r in spark.sql("SELECT req_id, answer, tokens, complete FROM answers_out").collect()]
    assert got == [(1, "bc", 2, True)]


def test_generation_over_http(spark):
    """Whole answers and streams of tokens from a service; a service that's down is an error, not a failure."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from ravelin.operators.rerank import HttpGenerator, generated, streamed

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            lines = [{"response": "a "}, {"response": ""}, {"response": asked["prompt"]}, {"done": True}, {"response": "late"}] if asked["stream"] else [{"response": f"{asked['model']}: {asked['prompt']}"}]
            body = "\n".join(map(json.dumps, lines)).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        model = HttpGenerator(f"http://127.0.0.1:{server.server_port}/", "m", timeout_s=20)
        prompts = spark.createDataFrame([(1, "x"), (2, None)], "query_id int, prompt string")
        assert [(r["answer"], r["error"]) for r in generated(prompts, model).orderBy("query_id").collect()] == [("m: x", None), (None, None)]
        assert [tuple(r) for r in streamed(prompts, model).orderBy("seq").collect()] == [(1, 0, "token", "a "), (1, 1, "token", "x"), (1, 2, "[DONE]", None)]
    finally:
        server.shutdown()
        server.server_close()
    assert generated(prompts, model).where("query_id = 1").first()["error"]
    assert [r["type"] for r in streamed(prompts, model).orderBy("seq").collect()] == ["error", "[DONE]"]
