"""Values that results depend on, stated once as plain text.

FIXED VALUES: names, formats, patterns, limits and messages below must stay as
they are for verdicts and tracking rows to come out right.
"""

# --- steps, in the order a document meets them -------------------------------
NODE_RECEPTION = "node1_file_reception"
NODE_FORMAT = "node2_format_validation"
NODE_EXTRACTION = "extraction"
NODE_CONTENT = "node3_content_validation"
NODE_DUPLICATE = "node4_duplicate_control"
NODE_CLEANER = "enrichment_text_cleaner"
NODE_ENTITIES = "enrichment_entity_extractor"
NODE_METADATA = "enrichment_metadata_enricher"
NODE_WHOLE_RUN = "pipeline"
NODE_ENRICHMENT = "enrichment"

# --- file formats -------------------------------------------------------------
PDF_MIME = "application/pdf"
UNKNOWN_MIME = "application/octet-stream"
ALLOWED_MIME_TYPES = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/octet-stream",
    "image/jpeg",
    "image/png",
    "image/tiff",
)
DISABLED_MIME_TYPES = ("text/html", "application/xhtml+xml")
DISABLED_EXTENSIONS = (".html", ".htm")
MIME_TO_EXTENSIONS = {
    "application/pdf": (".pdf",),
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": (".docx",),
    "image/jpeg": (".jpg", ".jpeg"),
    "image/png": (".png",),
    "image/tiff": (".tiff",),
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": (".xlsx",),
}
KNOWN_MISMATCHES = {
    "application/zip": (".docx",),
    "image/pjpeg": (".jpg", ".jpeg"),
}
MAX_FILE_SIZE_MB = 50

# --- thresholds -----------------------------------------------------------------
MIN_CHARS = 30
OCR_CHAR_THRESHOLD = 50
EXCERPT_LEN = 5000
ALLOWED_LANGUAGES = ("es", "en")
CONFIDENCE_THRESHOLD = 0.65
COSINE_THRESHOLD = 0.85
MIN_TEXT_FOR_OCR = 50
MIN_USABLE_TEXT = 20
REPEATED_LINE_MIN_COUNT = 3
MAX_ENRICHMENT_RETRIES = 2
ENTITY_EXCERPT_LEN = 5000
GIBBERISH_DETECTION_ENABLED = True
GIBBERISH_SHORT_TOKEN_RATIO = 0.6
GIBBERISH_MIN_TOKENS = 4
GIBBERISH_MAX_SHORT_TOKEN_LEN = 2

# --- messages -------------------------------------------------------------------
MSG_NO_FILE = "No file provided"
MSG_EMPTY_FILE = "File is empty"
MSG_TOO_LARGE = "File exceeds maximum allowed size of {limit_mb} MB"
MSG_FORMAT_REJECTED = "File format rejected: "
MSG_UNKNOWN_MIME = "Unknown MIME type, requires manual review: "
MSG_MODEL = "SLM: "
MSG_NO_TEXT = "PDF has no extractable text after OCR — needs human review"
MSG_TOO_SHORT = "Text too short: {chars} chars (min {min_chars})"
MSG_LANGUAGE = "Language not allowed: "
MSG_UNPARSABLE = "SLM response could not be parsed: "
MSG_NO_JSON = "No valid JSON object found in LLM output: "
MSG_LOW_CONFIDENCE = " (confidence %.2f below %.2f threshold)"
MSG_EXACT_DUPLICATE = "Exact duplicate: SHA-256 already in store"
MSG_NEAR_DUPLICATE = "Near-duplicate: cosine similarity %.3f"
MSG_ENRICHMENT_FAILED = "Enrichment failed after retries: "

# --- text patterns (Java regex) ----------------------------------------------------
# The characters Python's str.strip() and str.split() treat as white space.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
PAGE_NUMBER_PATTERN = (
    r"(?iU)^(p[aá]gina[\s\x1c-\x1f]+)?\d+([\s\x1c-\x1f]*/[\s\x1c-\x1f]*\d+)?\z"
)
TABLE_BORDER_PATTERN = r"(?U)^[\s\x1c-\x1f\-]+\z"
WHITESPACE_RUN_PATTERN = r"(?U)[\s\x1c-\x1f]+"
NOISE_PATTERN = (
    r"[^\p{L}\p{N}_\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.,;:()\-\"'ºª/%°$¿¡?!]"
)
MULTI_SPACE_PATTERN = " {2,}"
SUFFIX_PATTERN = r"^.+(\.[^.]+)$"

# --- model responses ------------------------------------------------------------------
LEGITIMACY_OBJECT_PATTERN = r"\{[^{}]+\}"
ENTITY_OBJECT_PATTERN = r"\{[^{}]*\}"
IS_LEGITIMATE_PATTERN = r'(?i)"is_legitimate"\s*:\s*(true|false)'
CONFIDENCE_PATTERN = r'"confidence"\s*:\s*([0-9]*\.?[0-9]+)'
REASONING_PATTERN = r'(?s)"reasoning"\s*:\s*"(.*)"\s*,\s*"confidence"'
DEFAULT_CONFIDENCE = 0.5
TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
FALSE_WORDS = ("0", "off", "f", "false", "n", "no")
FORMAT_DECISIONS = ("accept", "reject", "manual_review", "slm_escalate")
ACT_MARKERS = ("VISTO", "CONSIDERANDO", "ARTÍCULO", "DECRETA", "RESUELVE", "ORDENANZA")

# --- tracking -----------------------------------------------------------------------------
METADATA_SOURCE = "manual_upload"
UNNAMED_FILE = "unknown"
DECISION_TO_STATUS = {"accept": "accepted", "reject": "rejected", "escalate": "escalated"}
EVENT_NAME = "node_update"
REVIEW_PENDING = "pending"
REVIEW_ENRICHMENT_FAILED = "enrichment_failed"

# --- file signatures: (MIME type, offset, leading bytes in hex), first match wins -----------
SIGNATURES = (
    ("image/jpeg", 0, "FFD8FF"),
    ("image/png", 0, "89504E47"),
    ("image/gif", 0, "474946"),
    ("image/tiff", 0, "49492A00"),
    ("image/tiff", 0, "4D4D002A"),
    ("image/bmp", 0, "424D"),
    ("image/vnd.adobe.photoshop", 0, "38425053"),
    ("image/x-icon", 0, "00000100"),
    ("video/x-matroska", 0, "1A45DFA3"),
    ("video/x-flv", 0, "464C5601"),
    ("video/mpeg", 0, "000001BA"),
    ("audio/midi", 0, "4D546864"),
    ("audio/mpeg", 0, "494433"),
    ("audio/x-flac", 0, "664C6143"),
    ("audio/ogg", 0, "4F676753"),
    ("audio/amr", 0, "2321414D52"),
    ("application/x-rar-compressed", 0, "526172211A07"),
    ("application/gzip", 0, "1F8B08"),
    ("application/x-bzip2", 0, "425A68"),
    ("application/x-7z-compressed", 0, "377ABCAF271C"),
    ("application/x-xz", 0, "FD377A585A00"),
    ("application/pdf", 0, "25504446"),
    ("application/x-msdownload", 0, "4D5A"),
    ("application/rtf", 0, "7B5C727466"),
    ("application/x-sqlite3", 0, "53514C69"),
    ("application/x-executable", 0, "7F454C46"),
    ("application/postscript", 0, "2521"),
    ("application/font-woff", 0, "774F4646"),
    ("application/font-woff", 0, "774F4632"),
    ("application/x-tar", 257, "7573746172"),
    ("application/msword", 0, "D0CF11E0A1B11AE1"),
    ("application/wasm", 0, "0061736D"),
    ("image/vnd.dwg", 0, "41433130"),
    ("image/x-xcf", 0, "67696D7020786366"),
    ("image/jpx", 0, "0000000C6A502020"),
    ("image/vnd.ms-photo", 0, "4949BC"),
    ("video/x-ms-wmv", 0, "3026B2758E66CF11A6D9"),
    ("audio/aac", 0, "FFF1"),
    ("audio/aac", 0, "FFF9"),
    ("audio/mpeg", 0, "FFF2"),
    ("audio/mpeg", 0, "FFF3"),
    ("audio/mpeg", 0, "FFFB"),
    ("audio/x-aiff", 0, "464F524D00"),
    ("application/x-rpm", 0, "EDABEEDB"),
    ("application/dicom", 128, "4449434D"),
    ("application/x-shockwave-flash", 0, "435753"),
    ("application/x-shockwave-flash", 0, "465753"),
    ("application/x-nintendo-nes-rom", 0, "4E45531A"),
    ("application/x-google-chrome-extension", 0, "43723234"),
    ("application/vnd.ms-cab-compressed", 0, "4D534346"),
    ("application/vnd.ms-cab-compressed", 0, "49536328"),
    ("application/x-deb", 0, "213C617263683E0A64656269616E2D62696E617279"),
    ("application/x-unix-archive", 1, "3C617263683E"),
    ("application/x-compress", 0, "1FA0"),
    ("application/x-compress", 0, "1F9D"),
    ("application/x-lzop", 0, "894C5A4F000D0A1A0A"),
    ("application/x-lzip", 0, "4C5A4950"),
    ("application/x-lz4", 0, "04224D18"),
    ("application/zstd", 0, "28B52FFD"),
    ("application/font-sfnt", 0, "0001000000"),
    ("application/font-sfnt", 0, "4F54544F00"),
)
# EBML files whose document type says so, within their first bytes.
EBML_MIME = "video/x-matroska"
EBML_KINDS = (("video/webm", "4282847765626D"),)
EBML_HEAD_BYTES = 4096
# A TIFF file with these bytes at 8 is a camera's raw image.
TIFF_MIME = "image/tiff"
TIFF_KINDS = (("image/x-canon-cr2", "4352"),)
# Containers name their kind behind a size field: RIFF at byte 8, ISO media after "ftyp" at 4.
RIFF_KINDS = (
    ("image/webp", "57454250"),
    ("audio/x-wav", "57415645"),
    ("video/x-msvideo", "41564920"),
)
FTYP_KINDS = (
    ("image/heic", "68656963"),
    ("image/heic", "68656978"),
    ("image/heic", "6D696631"),
    ("image/heic", "6D736631"),
    ("image/avif", "61766966"),
    ("video/quicktime", "71742020"),
    ("video/x-m4v", "4D345620"),
    ("audio/mp4", "4D344120"),
    ("video/3gpp", "33677034"),
    ("video/3gpp", "33677035"),
    ("video/3gpp", "33677036"),
)
FTYP_MIME = "video/mp4"
# ZIP containers whose first member, stored as it is, names the kind.
ZIP_STORED_KINDS = (
    "application/epub+zip",
    "application/vnd.oasis.opendocument.text",
    "application/vnd.oasis.opendocument.spreadsheet",
    "application/vnd.oasis.opendocument.presentation",
)
ZIP_MIME = "application/zip"
ZIP_SIGNATURES = ("504B0304", "504B0506", "504B0708")
# ZIP containers are told apart by the folder their members lie in.
ZIP_MEMBER_FOLDERS = (
    ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "word/"),
    ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xl/"),
    ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "ppt/"),
)
