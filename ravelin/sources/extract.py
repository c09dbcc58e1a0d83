"""Text of files by their kind. Each function takes the bytes of one file and returns its text, or raises ValueError."""

from __future__ import annotations

import io
import shutil
import subprocess
import unicodedata
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

# The name spaces of text in word-processing and drawing markup.
NAMESPACES = ("http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main")
PDF_TIMEOUT_S = 60
SAMPLE, CONTROL_SHARE = 512, 0.10


def is_binary(data: bytes) -> bool:
    """Whether more than a tenth of the first 512 bytes are control characters other than white space."""
    head = data[:SAMPLE]
    return bool(head) and sum(b < 9 or 13 < b < 32 for b in head) > CONTROL_SHARE * len(head)


def markup_text(data: bytes) -> str:
    """Text runs, each followed by a space, with an empty line after each paragraph. Markup that breaks off gives what came before."""
    tags = {f"{{{ns}}}t" for ns in NAMESPACES}
    ends = {f"{{{ns}}}p" for ns in NAMESPACES}
    parser = ElementTree.XMLPullParser(("start", "end"))
    out: list[str] = []
    for at in range(0, len(data), 65536):
        try:
            parser.feed(data[at : at + 65536])
        except ElementTree.ParseError:
            pass
        try:
            for what, element in parser.read_events():
                if what == "end" and element.tag in tags and element.text:
                    out.append(f"{element.text} ")
                if what == "end" and element.tag in ends:
                    out.append("\n\n")
                if what == "end":
                    element.clear()
        except ElementTree.ParseError:
            break
    return "".join(out)


def docx(data: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return markup_text(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError) as e:
        raise ValueError(f"no document in it: {e}") from e


def pptx(data: bytes) -> str:
    """All slides in the archive's order, an empty line after each; a slide that can't be read is left out."""
    out: list[str] = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in z.namelist():
                if name.startswith("ppt/slides/slide") and name.endswith(".xml"):
                    try:
                        out.append(markup_text(z.read(name)) + "\n\n")
                    except (zipfile.BadZipFile, OSError):
                        continue
    except zipfile.BadZipFile as e:
        raise ValueError(f"no slides in it: {e}") from e
    return "".join(out)


def pdf(data: bytes) -> str:
    """Through the pdftotext program, where there is one; it gets the file by its standard input."""
    if not (program := shutil.which("pdftotext")):
        raise ValueError("pdftotext isn't installed")
    try:
        return subprocess.run([program, "-layout", "-enc", "UTF-8", "-", "-"], input=data, capture_output=True, timeout=PDF_TIMEOUT_S, check=True).stdout.decode("utf-8", "replace")
    except (subprocess.SubprocessError, OSError) as e:
        raise ValueError(f"pdftotext: {e}") from e


def plain(data: bytes) -> str:
    if is_binary(data):
        raise ValueError("binary")
    return data.decode("utf-8", "replace")


KINDS: dict[str, Callable[[bytes], str]] = {".docx": docx, ".pptx": pptx, ".pdf": pdf}


def extract(extension: str, data: bytes) -> str:
    return KINDS.get(extension, plain)(data)


def basename(path: str) -> str:
    """Last part of a path, composed (NFC), as files are cited."""
    return unicodedata.normalize("NFC", path.rstrip("/").rsplit("/", 1)[-1])
