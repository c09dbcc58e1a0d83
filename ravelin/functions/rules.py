"""Word lists and tables that results depend on. All of them are data: every operator takes its own as parameters."""

from __future__ import annotations

# Lists, prefixes and marks that must be equal for equal results.
IGNORED_EXTENSIONS = [
    ".pyc", ".exe", ".dll", ".so", ".zip", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".mp3", ".mp4", ".db", ".bin", ".woff", ".woff2", ".swf", ".ttf", ".otf",
    ".pages", ".key", ".numbers", ".plist", ".vpp", ".vux", ".pbxproj", ".xcscheme", ".xcworkspacedata", ".xcsettings", ".xcbkptlist", ".xcworkspace",
    ".js", ".css", ".map", ".sty", ".cls", ".bst", ".tex", ".yml", ".yaml", ".toml", ".lock", ".log", ".tmp", ".pkt", ".pka", ".gz", ".tar", ".rar", ".7z", ".rtf", ".bat", ".sh",
]
IGNORED_DIRECTORIES = ["node_modules", "__pycache__", ".git"]
DOMAINS = [
    ("[Domaine: Microcontrôleur ATmega328 AVR Électronique]", ["atm", "analog", "timer", "adc", "khin", "pwm", "datasheet"]),
    ("[Domaine: Réseau Protocoles Sécurité]", ["802", "reseau", "réseau", "cisco", "vlan", "trunk", "gardon", "mqtt"]),
    ("[Domaine: Cybersécurité DDoS]", ["ddos", "slowloris", "contremesure", "attaque"]),
    ("[Domaine: Communication Série I2C SPI UART Protocoles]", ["i2c", "spi", "uart", "serie", "infrarouge", "liaison", "communication"]),
    ("[Domaine: Programmation C C++]", ["cpp", "c_chap", "langage", "algo"]),
]
TECHNICAL_TERMS = [
    "adcs", "admux", "tccr", "timsk", "portb", "ddrb", "ddrd", "prescaler", "registre", "register", "bit ", "0x", "pwm", "uart", "spi", "i2c", "twi", "isr", "int0", "int1",
    "adps", "aden", "adsc", "adie", "adif", "refs", "wgm", "com", "ocr", "icr", "tcnt", "vlan", "trunk", "switchport", "802.1x", "ddos", "slowloris", "radius",
]
STOP_WORDS = [
    "comment", "fonctionne", "fonctionner", "quels", "quelle", "quelles", "quel", "quand", "pourquoi", "expliquer", "expliquez", "utiliser", "utilise", "donner", "faire",
    "avec", "dans", "pour", "vers", "depuis", "entre", "comme", "plus", "moins", "bien", "tout", "cette", "sont", "mais", "donc", "aussi", "même", "leur", "quoi", "être",
    "est", "les", "des", "une", "qui", "que", "sur", "par", "aux", "the", "and", "for",
]
EMBEDDING_STOP_WORDS = [
    "comment", "quels", "quelles", "quel", "quelle", "quoi", "pourquoi", "est", "sont", "dans", "avec", "pour", "vers", "entre", "comme", "tout", "cette", "mais", "donc", "aussi",
    "leur", "être", "les", "des", "une", "qui", "que", "sur", "aux", "the", "and", "for", "cest", "mon", "ma", "mes", "est-ce",
]
QUESTION_KINDS = [
    ("register", ["registre", "register", "adcsra", "admux", "adcsrb", "tccr", "timsk", "portb", "ddrd", "sreg", "spcr", "ucsr", "bit", "flag", "offset", "0x", "masque", "mask", "byte"]),
    ("calculation", ["calcul", "calculer", "formule", "valeur", "fréquence", "tension", "résistance", "courant", "ohm", "volt", "hz", "mhz", "prescaler", "diviseur", "combien", "quelle valeur", "résolution", "échantillonnage", "quantum", "can ", "adc "]),
    ("concept", ["comment fonctionne", "qu'est-ce", "expliquer", "définir", "principe", "différence entre", "pourquoi", "quand utiliser", "refs", "adlar", "mux", "tension de référence"]),
    ("code", ["code", "programme", "fonction", "arduino", "c++", "python", "loop", "setup", "void", "int ", "return", "for ", "while", "exemple", "syntaxe", "implémenter", "écrire", "gpio", "configurer", "piloter", "lire"]),
]
SMALL_TALK = [
    "hello", "bonjour", "salut", "hi", "hey", "coucou", "merci", "thanks", "thank you", "ca va", "comment tu vas", "comment vas-tu", "qui es-tu", "qui es tu", "tu es quoi", "tu t appelles", "ton nom",
    "au revoir", "bye", "a bientot", "ciao", "bien joue", "bravo", "super", "cool", "nickel", "aide", "help", "que sais-tu faire", "que peux-tu faire",
]
PLATFORMS = [
    ("atmega", ["ATmega", "ATmega328", "avr/io", "DDRB", "DDRD", "PORTB", "PORTD", "PINB", "PIND", "TCCR", "ADCSRA", "ADMUX", "avr/interrupt"]),
    ("stm32", ["STM32", "HAL_GPIO", "GPIOA", "GPIOB", "GPIOC", "RCC->", "HAL_Init", "NUCLEO", "stm32f", "HAL_Delay", "GPIO_InitTypeDef"]),
    ("esp32", ["ESP32", "ESP-IDF", "esp_gpio", "gpio_set_direction", "esp_err"]),
    ("arduino", ["Arduino", "pinMode", "digitalWrite", "digitalRead", "analogRead", "Serial.", "delay("]),
]
LARGE_MODELS = ["deepseek", "16b", "70b", "34b", "llama3"]
REFUSALS = ["pas decrit", "pas décrit", "non documenté", "désolé", "desole", "ne figure pas", "hors corpus", "not described"]
TRIMMED = ".,;:!?\"'()[]"
ACCENTED = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"
SPACE_CLASS = r"\t\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
EMBEDDING_PREFIX = "Represent this sentence for searching relevant passages: "
