"""Patterns, word lists and tables that results depend on.

Patterns are in the dialect of Java's regular expressions; they are anchored where a match
must start at the first character.
"""

# Page numbers (case-insensitive, whole content).
PAGE_NUMBER = [
    r"^page\s*\d+\s*(?:of\s*\d+)?$",
    r"^\d+\s*/\s*\d+$",
    r"^-\s*\d+\s*-$",
    r"^\[\s*\d+\s*\]$",
    r"^\d+$",
    r"^(?:p|pg|page)\.?\s*\d+$",
]

# Watermarks (case-insensitive).
WATERMARK = [
    r"^confidential\s*-?\s*(?:internal|external)?$",
    r"^draft\s*(?:copy)?$",
    r"^do\s+not\s+(?:copy|distribute)$",
    r"^for\s+internal\s+use\s+only$",
    r"^proprietary\s+(?:and\s+)?confidential$",
    r"^copy(?:right)?\s*©?\s*\d{4}",
    r"^all\s+rights\s+reserved\.?$",
    r"^www\.[a-zA-Z0-9]+\.[a-z]{2,}$",
    r"^sample\s*$",
    r"^preview\s*$",
    r"^watermark\s*$",
]

# Contents that recognition leaves behind.
ARTIFACT = [
    r"^[|_\-=+]{3,}$",
    r"^[\s.,!?;:]+$",
    r"^[^\p{L}\p{N}_\s]{2,}$",
    r"^[a-zA-Z]{1,2}$",
    r"^[0-9]{1,2}$",
]
CONSONANTS = r"(?i)[bcdfghjklmnpqrstvwxz]{5,}"

# Captions (case-insensitive).
TABLE_CAPTION = r"(?i)^(?:table|tbl\.?)\s*(\d+)[\s:.]*(.*)$"
FIGURE_CAPTION = r"(?i)^(?:figure|fig\.?|image|chart|diagram|graph)\s*(\d+)[\s:.]*(.*)$"
CAPTION_START = r"(?i)^(?:table|tbl\.?|figure|fig\.?|chart|graph|diagram|image)\s*\d+"
CAPTION_WORDS = ["figure", "fig.", "table", "chart", "diagram", "image"]

# Footnote contents and references.
FOOTNOTE = [r"^\[(\d+)\]\s*(.+)$", r"^\((\d+)\)\s*(.+)$", r"^(\d+)\.\s+(.+)$"]
SUPERSCRIPT = "¹²³⁴⁵⁶⁷⁸⁹⁰"
FOOTNOTE_START = [r"^\[\d+\]\s*", r"^\(\d+\)\s*", r"^\d+\.\s*[A-Z]", r"^[*†‡§]\s*"]

# Headings (case-sensitive).
HEADING = [
    r"^[A-Z][A-Z\s]{2,}$",
    r"^\d+\.\s+[A-Z]",
    r"^\d+\.\d+\s+[A-Z]",
    r"^Chapter\s+\d+",
    r"^Section\s+\d+",
    r"^Part\s+[IVX]+",
    r"^Abstract$",
    r"^Introduction$",
    r"^Conclusion$",
    r"^References$",
    r"^Bibliography$",
    r"^Acknowledgements?$",
    r"^Appendix\s*[A-Z]?$",
]
CHAPTER = r"^Chapter\s+\d+"

# List items, by kind.
UNORDERED = r"^\s*[-*+•○■]\s+"
ORDERED = r"^\s*(?:\d+[.)]|[a-z]\)|[ivx]+\.)\s+"
BULLETS = "•-*◦○▪▫–—"
LEGACY_BULLETS = "•-*◦○▪▫"

# Equations.
EQUATION = [r"^\$\$.*\$\$$", r"^\\\[.*\\\]$", r"^\\begin\{equation\}", r"^=\s*[a-zA-Z0-9+\-*/^()]+\s*$"]

# Running heads and feet, searched anywhere unless anchored.
RUNNING = [
    r"(?i)^Page\s+\d+",
    r"(?i)^\d+\s+of\s+\d+$",
    r"^-\s*\d+\s*-$",
    r"^\[\s*\d+\s*\]$",
    r"^\d+$",
    r"(?i)^Chapter\s+\d+",
    r"(?i)^Section\s+\d+\.?\d*",
    r"(?i)^Part\s+\d+",
    r"\d{1,2}/\d{1,2}/\d{2,4}",
    r"[\p{L}\p{N}_]+\s+\d{1,2},\s+\d{4}",
    r"\d{4}-\d{2}-\d{2}",
    r"(?i)Copyright\s*©",
    r"(?i)Confidential",
    r"(?i)Internal\s+Use\s+Only",
    r"(?i)Draft",
    r"(?i)All\s+Rights\s+Reserved",
]

# Phrases of a commenting model, by the three checks that look for them (case-insensitive).
COMMENTARY_FRAMEWORK = [
    r"based on (the|this) (image|document|page)",
    r"as (shown|seen|visible) in",
    r"it (appears|seems) that",
    r"I can (see|observe) that",
    r"the (image|document) shows",
    r"looking at (the|this)",
    r"from what I can (see|tell)",
    r"this (appears|seems) to be",
]
COMMENTARY_BASE = [
    r"based on (the|this) (image|document|page)",
    r"as (shown|seen|depicted) in (the|this)",
    r"it appears (that|to be)",
    r"this (seems|looks like)",
    r"I (can see|notice|observe)",
    r"the (image|document) (shows|contains|displays)",
    r"from what I can (see|tell)",
]
COMMENTARY_TYPED = [
    (r"based on (the|this) (image|document|page)", "commentary_phrase"),
    (r"as (shown|seen|depicted) in (the|this)", "commentary_phrase"),
    (r"it appears (that|to be)", "speculation"),
    (r"this (seems|looks like)", "speculation"),
    (r"I (can see|notice|observe|believe)", "first_person"),
    (r"the (image|document) (shows|contains|displays)", "meta_reference"),
    (r"from what I can (see|tell|determine)", "uncertainty"),
    (r"(probably|possibly|likely|perhaps)", "hedging"),
]

# Roles that the two validators accept.
LLM_ROLES = ["heading", "paragraph", "table", "list", "figure", "caption", "footnote", "equation", "code", "header", "footer", "page_number", "artifact", "watermark"]
OCR_ROLES = ["heading", "paragraph", "list_item", "table", "caption", "footnote"]

# Points by extraction method, first match wins.
METHOD_POINTS = [("OpenRouter", 20), ("Qwen", 18), ("Gemini", 17), ("pymupdf4llm", 15), ("GMFT", 14), ("RapidOCR", 12), ("Fallback", 8)]
DISPLAY_POINTS = [("OpenRouter", 30), ("GMFT", 25), ("RapidOCR", 20), ("PyMuPDF", 15)]

# Frequent words by language, in order of preference.
COMMON_WORDS = {
    "en": "the and is in to of a for that it with as was be",
    "de": "der die und in den von zu das mit sich des auf für",
    "fr": "le la les de un une et est en que des du qui dans",
    "es": "el la de que y en un una es se los las con por",
    "it": "il la di che e un una in è per non con del si",
    "pt": "o a de que e do da em um uma para é com não",
    "nl": "de het een van en in is op te dat die voor met",
    "id": "yang dan di untuk dengan dari ini itu ke dalam adalah",
    "tr": "bir ve bu için ile de da olarak olan var kadar gibi",
    "vi": "và của là có trong được cho với này các những đã",
}

# Scripts by code points, in order, and the language of those that have one.
SCRIPTS = {
    "latin": (0x0000, 0x024F),
    "cyrillic": (0x0400, 0x04FF),
    "arabic": (0x0600, 0x06FF),
    "devanagari": (0x0900, 0x097F),
    "bengali": (0x0980, 0x09FF),
    "myanmar": (0x1000, 0x109F),
    "thai": (0x0E00, 0x0E7F),
    "cjk": (0x4E00, 0x9FFF),
    "hangul": (0xAC00, 0xD7AF),
    "hiragana": (0x3040, 0x309F),
    "katakana": (0x30A0, 0x30FF),
    "greek": (0x0370, 0x03FF),
    "hebrew": (0x0590, 0x05FF),
}
SCRIPT_LANGUAGES = {"cyrillic": "ru", "arabic": "ar", "devanagari": "hi", "bengali": "bn", "myanmar": "my", "thai": "th", "hangul": "ko", "hebrew": "he", "greek": "el"}

# Model tiers with their label, rate per 1000 pages and rate per million tokens.
TIERS = [
    ("free", "Nemotron Nano 12B VL (FREE)", 0.0, 0.0),
    ("cheap", "Gemini 2.0 Flash Lite ($0.08/1K pages)", 0.08, 0.000075),
    ("balanced", "Qwen 2.5-VL 32B ($0.05/1K pages)", 0.05, 0.00005),
    ("quality", "Qwen 2.5-VL 72B ($0.15/1K pages)", 0.15, 0.00015),
    ("premium", "Mistral Pixtral Large ($2/1K pages)", 2.0, 0.002),
]
OCR_LANGUAGES = ["en", "ch_sim", "ch_tra", "ja", "ko", "ru"]
UPLOAD_GLOB = "*.{pdf,png,jpg,jpeg}"
