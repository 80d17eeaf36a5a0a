"""Fixed values that results depend on: word lists, extension kinds, routes, patterns."""

from __future__ import annotations

#: Stop words by language, in tie order.
STOP_WORDS: dict[str, frozenset[str]] = {
    "en": frozenset("the and is of to in that it for was on are with as this not have but be or by from at an you your they".split()),
    "fr": frozenset("le la les et est de des du un une que qui dans pour pas avec sur ce cette au aux plus se son sa ne mais tout nous vous ils elles".split()),
    "de": frozenset("der die das und ist von zu den dem ein eine einer mit sich auf für nicht im auch an als es sie er wir ich dass bei aus nach".split()),
}

#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = frozenset(
    "adm appt approx assn bros capt cmdr co col corp dept dr est ft gen gov hon inc jr lt ltd maj messrs mons mr mrs ms mt mx pres prof rep rev sen sgt sr st supt univ "
    "a.d a.m b.c b.c.e c.e e.g etc i.e p.m viz vs b.a d.d.s m.a m.d ph.d d.c u.k u.n u.s u.s.a "
    "aug dec feb jan jul jun mar nov oct sep sept fri mon sat sun thu thur thurs tue tues wed".split()
)

#: Extensions by kind.
EXTENSIONS: dict[str, str] = {
    "config": ".toml .ini .cfg .conf .env",
    "code": ".py .js .ts .jsx .tsx .java .c .cpp .cs .go .rb .rs .php .sh .bash .kt .swift .dart .scala .r .m .ps1 .sql .css .scss .less .vue .svelte",
    "markdown": ".md .markdown",
    "text": ".txt",
    "pdf": ".pdf",
    "csv": ".csv .tsv",
    "spreadsheet": ".xls .xlsx .ods",
    "notebook": ".ipynb",
    "docx": ".docx .odt .rtf",
    "pptx": ".pptx .ppt .odp",
    "tex": ".tex",
    "epub": ".epub",
    "image": ".png .jpg .jpeg .gif .webp .bmp .tiff .heic .svg",
    "diagram": ".drawio .vsdx .mmd",
    "audio": ".mp3 .wav .m4a .flac .ogg .aac",
    "video": ".mp4 .mkv .mov .avi .webm",
    "archive": ".zip .tar .gz .7z .rar",
    "email": ".eml .msg",
    "database": ".sqlite .db",
    "research": ".bib .ris",
    "web": ".html .htm .xml .json .rss",
}
KIND_BY_EXTENSION = {ext: kind for kind, exts in EXTENSIONS.items() for ext in exts.split()}
KIND_BY_SOURCE_TYPE = {k: k for k in "markdown text pdf csv spreadsheet notebook docx pptx code config image audio video archive email database research diagram".split()}
#: Extensions and names whose reader is not that of their kind, or that have no kind.
READER_BY_EXTENSION: dict[str, str] = {
    **dict.fromkeys(".txt .log .tex .rtf .json .xml .html .htm .rss .editorconfig".split(), "text"),
    **dict.fromkeys(".toml .ini .cfg .conf .yaml .yml .env".split(), "config"),
    **dict.fromkeys(".mmd".split(), "code"),
}
READER_BY_NAME = {".gitignore": "code", ".dockerignore": "code", ".editorconfig": "text", ".env": "config"}
#: Languages by code extension.
LANGUAGE_BY_EXTENSION: dict[str, str] = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java", ".c": "c", ".cpp": "c++", ".cs": "c#", ".go": "go",
    ".rb": "ruby", ".rs": "rust", ".php": "php", ".sh": "shell", ".bash": "shell", ".kt": "kotlin", ".swift": "swift", ".dart": "dart", ".scala": "scala", ".r": "r",
    ".m": "objective-c", ".ps1": "powershell", ".sql": "sql", ".css": "css", ".scss": "scss", ".less": "less", ".vue": "vue", ".svelte": "svelte",
}
DEFAULT_LANGUAGE = "generic"

#: Kinds that the watcher's worker processes.
PROCESSABLE_KINDS = ("code", "image", "audio", "video")
PROCESSABLE_EXTENSIONS = frozenset(".md .txt .pdf .csv .xlsx".split()) | {e for e, k in KIND_BY_EXTENSION.items() if k in PROCESSABLE_KINDS}

#: Classification confidence by kind.
DEFAULT_CONFIDENCE = 0.4
CONFIDENCE_BY_KIND = {
    **dict.fromkeys("markdown text code config pdf docx pptx tex notebook".split(), 0.92),
    **dict.fromkeys("csv spreadsheet image audio video diagram web".split(), 0.86),
    **dict.fromkeys("scanned_pdf handwritten epub archive email database research".split(), 0.80),
}

#: Processor and model by kind.
DEFAULT_PROCESSOR = ("TextProcessor", "general_text")
PROCESSOR_BY_KIND: dict[str, tuple[str, str]] = {
    "markdown": ("MarkdownProcessor", "general_text"),
    **dict.fromkeys(("web", "html", "json", "xml"), ("WebProcessor", "general_text")),
    **dict.fromkeys(("text", "unknown", "tex", "epub"), ("TextProcessor", "general_text")),
    "code": ("CodeProcessor", "programming"),
    "config": ("ConfigProcessor", "general_text"),
    "pdf": ("PDFProcessor", "general_text"),
    "scanned_pdf": ("OCRProcessor", "scanned_ocr"),
    "handwritten": ("HandwritingProcessor", "handwriting_ocr"),
    "docx": ("DocxProcessor", "general_text"),
    "pptx": ("PptxProcessor", "general_text"),
    "research": ("ResearchProcessor", "general_text"),
    **dict.fromkeys(("csv", "spreadsheet"), ("TableProcessor", "general_text")),
    "database": ("DatabaseProcessor", "general_text"),
    "notebook": ("NotebookProcessor", "general_text"),
    "image": ("VisionProcessor", "vision"),
    "audio": ("AudioProcessor", "audio"),
    "video": ("VideoProcessor", "vision"),
    "archive": ("ArchiveProcessor", "general_text"),
    "email": ("EmailProcessor", "general_text"),
    "diagram": ("DiagramProcessor", "general_text"),
}

#: What a processor stamps: (source type, or None for the document's own; confidence; confidence with a model).
PROCESSED_AS: dict[str, tuple[str | None, float, float]] = {
    "TextProcessor": (None, 0.95, 0.95),
    "MarkdownProcessor": ("markdown", 0.95, 0.95),
    "WebProcessor": ("web", 0.90, 0.90),
    "CodeProcessor": ("code", 0.92, 0.92),
    "ConfigProcessor": ("config", 0.93, 0.93),
    "PDFProcessor": ("pdf", 0.90, 0.90),
    "DocxProcessor": ("docx", 0.90, 0.90),
    "PptxProcessor": ("pptx", 0.88, 0.88),
    "ResearchProcessor": ("research", 0.88, 0.88),
    "TableProcessor": (None, 0.88, 0.88),
    "DatabaseProcessor": ("database", 0.85, 0.85),
    "NotebookProcessor": ("notebook", 0.90, 0.90),
    "VideoProcessor": ("video", 0.70, 0.70),
    "ArchiveProcessor": ("archive", 0.80, 0.80),
    "EmailProcessor": ("email", 0.88, 0.88),
    "VisionProcessor": ("image", 0.70, 0.85),
    "AudioProcessor": ("audio", 0.60, 0.85),
    "OCRProcessor": ("scanned_pdf", 0.50, 0.82),
    "HandwritingProcessor": ("handwritten", 0.40, 0.75),
    "DiagramProcessor": ("diagram", 0.85, 0.85),
}

#: Entity patterns (type, pattern, group of the label), in order of precedence.
ENTITY_PATTERNS: tuple[tuple[str, str, int], ...] = (
    ("technology", r"\b[A-Z][A-Za-z0-9+.-]*\s+\d+(?:\.\d+)+\b", 0),
    ("person", r"\b(?:Mr|Mrs|Ms|Dr|Prof|Professor|Sir|Lady|Miss)\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", 1),
    (
        "organization",
        r"\b[A-Z][a-zA-Z0-9&]+(?:\s+[A-Z][a-zA-Z0-9&]+)*\s+(?:Inc|Corp|Corporation|Ltd|LLC|GmbH|University|Institute|Foundation|Laboratories|Labs|Technologies|Systems|Group|Agency|Council|Association|Society|Company)\b",
        0,
    ),
    ("place", r"\b(?:in|at|from|to|near|throughout|across)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", 1),
    ("paper", r'"([A-Z][^"\n]{2,120})"\s*(?:\(\d{4}\))?', 1),
    ("concept", r"\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b", 0),
)

#: Line shapes of Markdown.
LIST_ITEM = r"^(\s*)([-*+]|\d+[.)])\s+"
TABLE_RULE = r"^\s*\|?[\s:-]+(?:\|[\s:-]+)+\|?\s*$"
ATX_HEADING = r"^(#{1,6})\s+(\S.*)$"
CHUNK_HEADING = r"^#{1,6}\s+.+"
FENCE = r"^ {0,3}(`{3,}|~{3,})(.*)$"
TABLE_OPEN = r"<\s*table\b"
TABLE_CLOSE = r"</\s*table\s*>"
CALLOUT = r"^>+[ \t]*\s*\[[ \t]*![ \t]*([A-Za-z][A-Za-z0-9-]*)[ \t]*\]"
DEFINITION = r"^\s*:[ \t]"
#: Marks that may follow a sentence's end.
CLOSING_MARKS = "\"'”’»」』)]"

#: Line shapes of code in other languages.
CODE_LINES: tuple[tuple[str, str], ...] = (
    ("function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
    ("class", r"(?:export\s+)?class\s+(\w+)"),
    ("import", r"(?:import|from)\s+([\w.]+)"),
)
