"""Fixed values of the data model: tables, lists and constants that results depend on."""

# fixed values: loader name by extension, anything else is text_loader
LOADERS = {
    "text_loader": ["txt", "md", "json", "xml", "yaml", "yml", "log"],
    "pypdf_loader": ["pdf"],
    "image_loader": ["png", "dwg", "xcf", "jpg", "jpe", "jpeg", "jpx", "apng", "gif", "webp", "cr2", "tif", "tiff", "bmp", "jxr", "psd", "ico", "heic", "avif"],
    "audio_loader": ["aac", "mid", "mp3", "m4a", "ogg", "flac", "wav", "amr", "aiff"],
    "csv_loader": ["csv"],
    "unstructured_loader": ["docx", "doc", "odt", "xlsx", "xls", "ods", "pptx", "ppt", "odp", "rtf", "epub", "eml", "msg"],
    "beautiful_soup_loader": ["html", "htm"],
}

# fixed values: document type by extension, anything else is skipped
DOCUMENT_TYPES = {
    "pdf": ["pdf"],
    "text": ["txt"],
    "csv": ["csv"],
    "unstructured": ["docx", "doc", "odt", "xls", "xlsx", "ppt", "pptx", "odp", "ods"],
    "image": ["png", "dwg", "xcf", "jpg", "jpx", "apng", "gif", "webp", "cr2", "tif", "bmp", "jxr", "psd", "ico", "heic", "avif"],
    "audio": ["aac", "mid", "mp3", "m4a", "ogg", "flac", "wav", "amr", "aiff"],
    "html": ["html", "htm"],
}

# fixed values: class name by document type, anything else is Document
DOCUMENT_CLASSES = {
    "text": "TextDocument",
    "pdf": "PdfDocument",
    "csv": "CsvDocument",
    "image": "ImageDocument",
    "audio": "AudioDocument",
    "html": "TextDocument",
    "unstructured": "UnstructuredDocument",
    "dlt_row": "DltRowDocument",
}

# fixed values: stop words of lexical ranking and titles
STOP_WORDS = (
    "a an the and or but is are was were in on at to for with by about of from as that this these those it its them they their he she his her him "
    "we our you your not be been being have has had do does did can could will would shall should may might must when where which who whom whose why how"
).split()

# fixed values: name space of all deterministic identifiers (the ISO OID name space of RFC 4122)
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"

# fixed values: constants of ranking
BM25_K1, BM25_B = 1.5, 0.75
F32_EPSILON = 1.1920929e-07
TRIPLET_PENALTY = 6.5
WIDE_K, TOP_K = 100, 10
MATCH_THRESHOLD = 0.8

# fixed values: idle time after which a running session counts as abandoned, and the gap that ends a run
ABANDON_SECONDS, RUN_GAP_MS = 1800, 300_000

# fixed values: patterns of secrets; the first six characters of a match stay
SECRET_PATTERNS = [
    r"sk-[A-Za-z0-9]{20,}",
    r"""(?i)(?:api[_-]?key\s*[=:]\s*)['"]?[A-Za-z0-9\-_]{16,}['"]?""",
    r"(?i)(?:bearer\s+)[A-Za-z0-9\-_\.]{20,}",
    r"""(?i)(?:password\s*[=:]\s*)['"]?[^\s'"]{8,}['"]?""",
]

# fixed values: characters that end a sentence
SENTENCE_ENDS = ".;!?…。！？"

# fixed values: router rules as (target, weight, case sensitive pattern or not, pattern); words need word boundaries on both sides
ROUTER_WORDS = [
    ("CodingRules", 5.0, ["coding rule", "coding rules", "code review", "best practice", "lint", "linting", "linter", "refactor", "refactoring"]),
    ("ChunksLexical", 4.0, ["exact", "verbatim", "literal", "word for word", "word-for-word", "word.for.word", "word_for_word"]),
    (
        "GraphSummaryCompletion",
        5.0,
        ["summarize", "summary", "overview", "outline", "tldr", "tl;dr", "gist", "main point", "main points", "key takeaway", "key takeaways", "high level", "high-level", "highlevel"],
    ),
    ("GraphCompletionCot", 4.0, ["why", "explain", "reasoning", "step by step", "step-by-step", "step.by.step", "chain of thought"]),
    ("GraphCompletionCot", 2.0, ["because", "therefore", "consequently"]),
    ("GraphCompletionContextExtension", 3.0, ["connection", "relationship", "related to", "linked to"]),
    ("Temporal", 3.0, ["when", "before", "after", "during", "since", "until"]),
    ("Temporal", 4.0, ["timeline", "chronolog", "chronology", "chronological", "era", "decade", "century"]),
]
ROUTER_PATTERNS = [
    ("Cypher", 10.0, r"(^MATCH\s|^RETURN\s|^CREATE\s|^MERGE\s|--\(|\)--)"),
    ("CodingRules", 3.0, r"(?i)\b(def |return |async |await |import |class \w+\(|\.py\b|function\s+\w+\()"),
    ("ChunksLexical", 8.0, r'^"[^"]+"$'),
    ("GraphCompletionContextExtension", 5.0, r"(?i)\b(how (is|are|does|do)\s+\w+\s+(related|connected|linked))\b"),
    ("GraphCompletionContextExtension", 5.0, r"(?i)\b(what (connects|links|ties)|path between|degree of separation)\b"),
    ("Temporal", 3.0, r"\b\d{4}s?\b"),
    ("Temporal", 6.0, r"(?i)\bbetween\s+\d{4}\s+and\s+\d{4}\b"),
]
NEGATIONS = ["not", "n't", "no", "never", "without", "lack"]
NEGATION_WINDOW, ROUTER_DEFAULT, ROUTER_BASE = 20, "GraphCompletion", 2.0

# fixed values: stage of a node by its type (anything else is other), the order of the stages, and relationships that only hold structure
STAGE_BY_TYPE = {
    "TextDocument": "document",
    "DocumentChunk": "chunk",
    "TextSummary": "summary",
    "GlobalContextSummary": "context",
    "Entity": "entity",
    "EntityType": "type",
    "DatabaseSchema": "schema",
    "SchemaTable": "schema",
    "SchemaRelationship": "schema",
    "TableType": "schema",
    "TableRow": "schema",
    "ColumnValue": "schema",
}
STAGE_ORDER = ["document", "chunk", "entity", "type", "summary", "context", "schema", "other"]
STRUCTURAL_RELATIONS = ["contains", "is_a", "part_of", "is_part_of", "has_relationship", "made_from", "summarized_in"]
