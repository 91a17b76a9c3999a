"""Fixed values of the compliance domain. All are defaults; the operators take them as parameters."""

#: Units, in EMU.
EMU_PER_INCH, EMU_PER_POINT = 914_400, 12_700

#: The palette, whose order breaks ties between equally near colours.
PALETTE = """
FFFFFF 000000 F2F2F2 808080 D9D9D9 595959 BFBFBF 404040 A6A6A6 262626 0D0D0D
75FDF7 E1FFFE C7FEFB ABFEFA 18FCF0 03B6AD
006EBE BDE3FF 7DC8FF 3EADFF 00518C 00365E
7DD7FF E3F7FF CAEFFF B0E8FF 1EBBFF 0085BD
B9FF6E F1FFE1 E2FFC4 D6FFA8 8FFF13 60B700
FFFF50 FFFFDB FFFFB9 FFFF95 FBFB00 A8A800
FF3737 FFD7D7 FFAEAE FF8686 E80000 9B0000
FFCD69 FFF4DF FFEBC1 FFE1A4 FFB00D B37800
972FFF EAD5FF D5AAFF C082FF 7100E1 4B0097
""".split()
HEADER_FILL, STATS_FILL = "006EBE", "FFFFDB"

#: Words that are no client names, compared in upper case.
STOP_WORDS = "THE AI M&A CEO LLC INC CORP JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER DRAFT EXECUTIVE SUMMARY PEER GROUP TITLE POSITION COMPANY".split()
CANONICAL_FOOTER = "These materials are confidential and to be used only by the client to whom they are addressed"

#: Severities in their order, and the rules' category, severity and confidence.
SEVERITIES = ("error", "warning", "info")
RULES = {
    "font-family": ("typography", "error", 0.95),
    "title-size": ("title", "warning", 0.85),
    "title-bold": ("title", "warning", 0.80),
    "title-punct": ("title", "warning", 0.90),
    "title-lines": ("title", "warning", 0.88),
    "draft-designator": ("title", "error", 0.90),
    "title-date": ("title", "info", 0.50),
    "title-authors": ("title", "info", 0.45),
    "confidentiality-missing": ("confidentiality", "error", 0.90),
    "confidentiality-modified": ("confidentiality", "error", 0.70),
    "confidentiality-moved": ("confidentiality", "warning", 0.75),
    "confidentiality-overlap": ("confidentiality", "warning", 0.65),
    "term-percentile": ("terminology", "warning", 0.82),
    "term-tgt": ("terminology", "warning", 0.90),
    "term-incumbent": ("terminology", "warning", 0.85),
    "term-company-name": ("terminology", "info", 0.60),
    "table-font-consistency": ("table", "warning", 0.75),
    "table-side-border": ("table", "warning", 0.70),
    "table-statsrow-color": ("table", "warning", 0.78),
    "table-merged-body": ("table", "info", 0.50),
    "table-title-centered": ("table", "info", 0.50),
    "off-palette-color": ("color", "warning", 0.50),
    "title-moved": ("title", "info", 0.45),
    "bullet-punct": ("bullets", "info", 0.55),
}

#: Thresholds of the rules.
TITLE_SIZE_PT, SIZE_TOLERANCE_PT, TITLE_LINES, TITLE_WIDTH_IN = 24.0, 0.5, 3, 8.5
TITLE_MOVED_IN, FOOTER_MOVED_IN, OVERLAP_SHARE = 0.12, 0.08, 0.45
FOOTER_LIKE, FOOTER_CLOSE, FOOTER_SAME = 0.5, 0.6, 0.97
COLOUR_TOLERANCE, COLOURS_PER_SLIDE = 8, 4
MODE_SHARE, MODE_CELLS, CENTRE_IN = 0.6, 4, 0.1
PRIMARY_CONFIDENCE, REVIEW_CONFIDENCE = 0.6, 0.6

#: Patterns. ASCII word boundaries are spelled out, as Java's \b follows Unicode.
DRAFT = r"(?<![A-Za-z0-9_])(DRAFT|WIP|INTERNAL ONLY|DO NOT DISTRIBUTE|PRELIMINARY)(?![A-Za-z0-9_])"
DATE = (
    r"(?<![A-Za-z0-9_])(?:(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}"
    r"|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})(?![A-Za-z0-9_])"
)
STATS_LABEL = r"(?i)^(?:median|mean|average|count|25th|75th|50th|percentile|%ile|p25|p50|p75|min|max)"
TERMS = (
    # rule, where it looks, pattern, replacement, for the whole deck, ignoring case
    ("term-percentile", "prose", r"(?i)(?<![A-Za-z0-9_])percentile(?![A-Za-z0-9_])", "percentile", "%ile", True, True),
    ("term-tgt", "prose", r"(?<![A-Za-z0-9_])TGT(?![A-Za-z0-9_])", "TGT", "Target", True, False),
    ("term-incumbent", "header", r"(?i)(?<![A-Za-z0-9_])incumbent(?![A-Za-z0-9_])", "Incumbent", "Executive", False, True),
    ("term-company-name", "header", r"(?i)^company name\z", "Company Name", "Company", False, True),
)

#: What reviewers marked in the annotated deck, by slide and by the layer that is to find it.
GROUND_TRUTH = {
    1: {"deterministic": ["draft"]},
    2: {"ai": ["bullets-parallel"]},
    3: {
        "deterministic": ["percentile", "table-title-centered", "title-moved", "title-lines"],
        "ai": ["client-name", "bullets-parallel"],
        "hard": ["legend-spacing", "legend-box", "first-col-margin"],
    },
    4: {"deterministic": ["font-consistency", "title-moved"]},
    5: {"deterministic": ["percentile"], "ai": ["legend-order"], "hard": ["first-col-margin"]},
    6: {"deterministic": ["merged-cells"], "hard": ["first-col-margin"]},
    9: {"deterministic": ["title-lines"]},
    10: {"deterministic": ["confidentiality-missing"], "ai": ["legend-naming"], "hard": ["legend-spacing"]},
    11: {"ai": ["legend-order", "missing-units", "propernoun-punct"]},
    12: {"deterministic": ["confidentiality-overlap", "company-name"]},
    13: {"deterministic": ["confidentiality-missing", "statsrow-color"], "ai": ["legend-naming"]},
    14: {"deterministic": ["confidentiality-missing", "statsrow-color"], "ai": ["legend-naming"], "hard": ["missing-labels"]},
    23: {"deterministic": ["confidentiality-missing"]},
    24: {"deterministic": ["confidentiality-moved"]},
}
#: The tag of a rule's findings, and those of a reviewer's categories.
RULE_TAGS = {
    "draft-designator": "draft",
    "term-percentile": "percentile",
    "term-company-name": "company-name",
    "term-incumbent": "incumbent",
    "table-font-consistency": "font-consistency",
    "table-statsrow-color": "statsrow-color",
    "table-merged-body": "merged-cells",
    "table-title-centered": "table-title-centered",
    "confidentiality-missing": "confidentiality-missing",
    "confidentiality-modified": "confidentiality-modified",
    "confidentiality-moved": "confidentiality-moved",
    "confidentiality-overlap": "confidentiality-overlap",
    "title-moved": "title-moved",
    "title-lines": "title-lines",
    "title-punct": "title-punct",
}
CATEGORY_TAGS = {
    "bullets": ["bullets-parallel"],
    "title": ["title-lines"],
    "consistency": ["client-name", "legend-order", "legend-naming"],
    "terminology": ["company-name", "legend-naming"],
    "table": ["missing-units"],
    "content": ["propernoun-punct", "missing-units"],
    "footnote": ["propernoun-punct"],
}

#: What a bullet's character means in the fonts of symbols, and what stands for others of them.
BULLETS = {
    "wingdings": {"§": "▪", "Ø": "➔", "n": "▪", "l": "●", "u": "◆", "ü": "✓", "Ö": "♦"},
    "symbol": {"·": "•", "¨": "•"},
}
OTHER_BULLET = {"wingdings": "▪", "symbol": "•"}
