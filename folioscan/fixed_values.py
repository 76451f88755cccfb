"""Code lists, lookup tables, patterns and limits.

These are the constants of the listing domain that results depend on. They are
kept together here, as plain text, in the order in which they are tried.
"""

# --- code domains -----------------------------------------------------------
SESSION_KINDS = ("NORMAL", "REMPLACEMENT")
SERIES = ("GENERALE", "PROFESSIONNELLE", "TOUTES")
DISCIPLINES = (
    "FR_DICTEE", "FR_GRAM_COMP", "FR_REDACTION", "HIST_GEO_EMC",
    "LV_ALLEMAND", "LV_ANGLAIS", "LV_ARABE", "LV_CHINOIS", "LV_ESPAGNOL", "LV_GREC",
    "LV_HEBREU", "LV_ITALIEN", "LV_JAPONAIS", "LV_PORTUGAIS", "LV_RUSSE", "LV_TURC",
    "MATHS", "SCIENCES",
)
LOCATIONS = (
    "AM_NORTH", "AM_SOUTH", "ANTIL_GUY", "ASIA", "LIBAN", "METROPOLE",
    "METRO_ANTIL_GUY", "NOUVELLE_CAL", "GROUPE_1", "POLYNESIE", "PONDICHERY",
)

# --- label rules: first rule wins ------------------------------------------
# A rule is a code and conditions that must all hold. A condition holds when one
# of its parts occurs anywhere, or one of its words between word bounds. Rules
# run on trimmed lower-case text.
SESSION_RULES = (
    ("NORMAL", ({"words": ("normal", "normale", "normales")},)),
    ("REMPLACEMENT", ({"words": ("remplacement", "septembre")},)),
)
SERIE_RULES = (
    ("GENERALE", ({"words": ("générale", "generale", "gen")},)),
    ("PROFESSIONNELLE", ({"words": ("professionnelle", "professionnel", "pro")},)),
    ("TOUTES", ({"words": ("toutes",)},)),
)
DISCIPLINE_RULES = (
    ("FR_DICTEE", ({"parts": ("fran",)}, {"parts": ("dict",)})),
    (
        "FR_GRAM_COMP",
        (
            {"words": ("français", "francais")},
            {"words": ("grammaire", "compréhension", "comprehension", "question", "questions")},
        ),
    ),
    ("FR_REDACTION", ({"words": ("français", "francais")}, {"words": ("rédaction", "redaction")})),
    ("HIST_GEO_EMC", ({"parts": ("histoire", "histore", "géographie", "geographie"), "words": ("emc",)},)),
    ("LV_ALLEMAND", ({"words": ("allemand",)},)),
    ("LV_ANGLAIS", ({"words": ("anglais",)},)),
    ("LV_ARABE", ({"words": ("arabe",)},)),
    ("LV_CHINOIS", ({"words": ("chinois",)},)),
    ("LV_ESPAGNOL", ({"words": ("espagnol",)},)),
    ("LV_GREC", ({"words": ("grec",)},)),
    ("LV_HEBREU", ({"words": ("hébreu", "hebreu")},)),
    ("LV_ITALIEN", ({"words": ("italien",)},)),
    ("LV_JAPONAIS", ({"words": ("japonais",)},)),
    ("LV_PORTUGAIS", ({"words": ("portugais",)},)),
    ("LV_RUSSE", ({"words": ("russe",)},)),
    ("LV_TURC", ({"words": ("turc",)},)),
    ("MATHS", ({"words": ("math", "maths", "mathématiques", "mathematiques")},)),
    ("SCIENCES", ({"parts": ("physique", "chimie", "technologie"), "words": ("science", "sciences", "svt")},)),
)
# Exact location labels, tried before the patterns.
LOCATION_LABELS = {
    "amérique du nord": "AM_NORTH",
    "amerique du nord": "AM_NORTH",
    "amérique du sud": "AM_SOUTH",
    "amerique du sud": "AM_SOUTH",
    "antilles, guyane": "ANTIL_GUY",
    "antilles , guyane": "ANTIL_GUY",
    "antilles guyane": "ANTIL_GUY",
    "asie": "ASIA",
    "liban": "LIBAN",
    "métropole": "METROPOLE",
    "metropole": "METROPOLE",
    "métropole et antilles-guyane": "METRO_ANTIL_GUY",
    "metropole et antilles-guyane": "METRO_ANTIL_GUY",
    "nouvelle-calédonie": "NOUVELLE_CAL",
    "nouvelle caledonie": "NOUVELLE_CAL",
    "groupe 1": "GROUPE_1",
    "polynésie": "POLYNESIE",
    "polynesie": "POLYNESIE",
    "pondichéry": "PONDICHERY",
    "pondichery": "PONDICHERY",
}
# Location rules run on text whose runs of blanks are one blank.
LOCATION_RULES = (
    ("AM_NORTH", ({"parts": ("amérique du nord", "amerique du nord")},)),
    ("AM_SOUTH", ({"parts": ("amérique du sud", "amerique du sud")},)),
    (
        "ANTIL_GUY",
        (
            {
                "parts": (
                    "antillesguyane", "antilles guyane", "antilles,guyane",
                    "antilles, guyane", "antilles ,guyane", "antilles , guyane",
                )
            },
        ),
    ),
    (
        "METRO_ANTIL_GUY",
        (
            {
                "parts": (
                    "métropole et antilles-guyane", "métropole et antilles guyane",
                    "metropole et antilles-guyane", "metropole et antilles guyane",
                )
            },
        ),
    ),
    ("METROPOLE", ({"parts": ("métropole", "metropole")},)),
    (
        "NOUVELLE_CAL",
        ({"parts": ("nouvelle-calédonie", "nouvelle calédonie", "nouvelle-caledonie", "nouvelle caledonie")},),
    ),
    ("POLYNESIE", ({"parts": ("polynésie", "polynesie")},)),
    ("PONDICHERY", ({"parts": ("pondichéry", "pondichery")},)),
    ("GROUPE_1", ({"words": ("groupe 1", "groupe1")},)),
    ("LIBAN", ({"words": ("liban",)},)),
    ("ASIA", ({"words": ("asie",)},)),
)

# --- metadata words, tried in order ----------------------------------------
SUBJECT_WORDS = (
    ("mathematiques", "Mathématiques"),
    ("maths", "Mathématiques"),
    ("francais", "Français"),
    ("histoire", "Histoire-Géographie"),
    ("geographie", "Histoire-Géographie"),
    ("histoire-geographie", "Histoire-Géographie"),
    ("sciences", "Sciences"),
    ("svt", "Sciences (SVT)"),
    ("physique", "Sciences (Physique-Chimie)"),
    ("chimie", "Sciences (Physique-Chimie)"),
    ("technologie", "Sciences (Technologie)"),
    ("anglais", "Anglais LV1"),
    ("allemand", "Allemand LV1"),
    ("espagnol", "Espagnol LV1"),
    ("italien", "Italien LV1"),
)
# Combined spellings: a part that all of them contain, the pattern, the subject.
SUBJECT_FORMS = (
    ("geo", "hist(oire)?[-_]?geo(graphie)?", "Histoire-Géographie"),
    ("chim", "phys(ique)?[-_]?chim(ie)?", "Sciences (Physique-Chimie)"),
)
SESSION_WORDS = ("normale", "remplacement", "septembre", "juin")
PRO_SERIES_WORDS = ("professionnelle", "pro")
CORRECTION_PARTS = ("corrig", "correction", "corrige", "reponses", "solutions", "answer", "key")

# --- links and file types ---------------------------------------------------
DOCUMENT_LINK = r"/document/[^/]+/download"
DOCUMENT_ID = r"/document/([^/]+)/download"
LINK_NAME_ATTRIBUTE = "data-atl-name"
ENTRY_NAME_ATTRIBUTE = "data-ati-name"

CONTENT_TYPES = {
    "application/pdf": ".pdf",
    "application/zip": ".zip",
    "application/x-zip-compressed": ".zip",
    "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.oasis.opendocument.text": ".odt",
    "application/rtf": ".rtf",
    "text/rtf": ".rtf",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
}
MAGIC_BYTES = (
    (b"%PDF", ".pdf", "application/pdf"),
    (b"PK\x03\x04", ".zip", "application/zip"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", ".doc", "application/msword"),
    (b"{\\rtf", ".rtf", "application/rtf"),
    (b"Rar!", ".rar", "application/x-rar-compressed"),
)
UNKNOWN_EXTENSION = ".bin"
UNKNOWN_MIME = "application/octet-stream"
DEFAULT_EXTENSION = ".pdf"
DEFAULT_FILE_NAME = "downloaded_file.pdf"

MIN_FILE_BYTES = 100
MIN_PDF_BYTES = 1024
MIN_DOC_BYTES = 1000  # a .doc must be larger than this
MAX_NAME_LENGTH = 255

BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")

VALIDATION_COLUMNS = (
    "ID", "IDFile", "Session", "Discipline", "Serie", "Localisation",
    "Files_Count", "Status", "FileName", "FileNameToSave", "Link",
)
