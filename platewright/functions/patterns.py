"""Patterns and constants that results must agree on.

Fixed values, each stated as it has to be matched; ``(?i)`` variants ignore case,
also of Greek letters where ``(?iu)`` is written.
"""

# Patterns.
TAXON_CANDIDATE = r"\b([A-Z][a-zA-Z-]+\s+(?:sp\.|spp\.|cf\.|aff\.|[a-z][a-zA-Z-]+))\b"
TAXON_RULE = r"\b([A-Z][a-zA-Z-]+\s+[a-z][a-zA-Z-]+(?:\s*(?:sp\.|spp\.|cf\.|aff\.))?)\b"
TAXON_IN_CAPTION = r"\b([A-Z][a-zA-Z-]+\s+[a-z][a-zA-Z-]+(?:\s+(?:sp\.|spp\.|cf\.|aff\.))?)\b"
PANEL_LABEL = r"(?:\(|\[)?([A-Z]|[0-9]{1,2})(?:\)|\])?(?=\s*[:\.\-\)]|\s|,)"
CAPTION_LEAD = r"(?i)^(?:fig(?:ure)?|plate)\s*\.?\s*(\d+[A-Za-z]?)\b[:\-\.]?\s*"
FIGURE_REFERENCE = r"(?i)\b(?:fig(?:ure)?|plate)\s*\.?\s*"
NUMBER_IN_ID = r"(\d+[A-Za-z]?)"
AGE = (
    r"(?i)\b(Precambrian|Cambrian|Ordovician|Silurian|Devonian|Carboniferous|Permian|Triassic|Jurassic|Cretaceous|Paleocene|Eocene"
    r"|Oligocene|Miocene|Pliocene|Pleistocene|Holocene|Early\s+[A-Z][a-z]+|Middle\s+[A-Z][a-z]+|Late\s+[A-Z][a-z]+)\b"
)
FORMATION = r"\b([A-Z][A-Za-z\-\s]+(?:Formation|Member|Group|Fm\.|Mb\.|Gp\.))\b"
LOCALITY = r"\b(?:from|at|in)\s+([A-Z][A-Za-z\-\s]{2,80})\b"
SCALE = r"(?iu)(?:scale\s*bar\s*(?:=|:)?\s*|bar\s*=\s*)(\d+(?:\.\d+)?)\s*(μm|um|mm|nm)"
JSON_OBJECT = r"(?s)\{.*\}"
LABEL_TOKEN = r"^([A-Z]|\d{1,2})$"
QUALIFIER = r"(?i)\b(sp\.|spp\.|cf\.|aff\.)\b"

# Python's classes for str in the words of Java, whose own are ASCII: digits and letters of all scripts, every white space.
_WORD, _SPACE, _DIGIT = r"\p{L}\p{N}_", r"\s\x1c-\x1f\x85\p{Z}", r"\p{Nd}"
_EDGE = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"


def unicode_aware(pattern: str) -> str:
    r"""``pattern`` with the meaning that \b, \s, \w, \d and (?i) have on whole, unaltered texts."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        piece = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        at += len(piece)
        inside = piece == "[" or (inside and piece != "]")
        kind = {r"\w": _WORD, r"\s": _SPACE, r"\d": _DIGIT}.get(piece)
        if kind:
            piece = kind if inside else f"[{kind}]"
        elif piece == r"\b" and not inside:
            piece = _EDGE
        out.append(piece)
    return "".join(out).replace("(?i)", "(?iu)")


# Scores, thresholds and limits.
SCORE_CANDIDATE, SCORE_RULE, SCORE_LEXICON = 0.65, 0.55, 0.75
CONF_SCALE_CAPTION, CONF_SCALE_OCR = 0.8, 0.7
CONF_GEOLOGY_RULE, LINK_LEAST, LINKS_KEPT = 0.55, 0.4, 5
PLUS_LABEL, PLUS_SPECIES, PLUS_OCR, CONF_MOST = 0.08, 0.12, 0.03, 0.99
CONF_NO_PANEL, CONF_WHOLE_REGION, SCORE_WHOLE_PAGE = 0.35, 0.4, 0.5
REGION_AREA, REGION_SHARE, REGION_ASPECT = 8000, 0.98, (0.15, 8.0)
PANEL_AREA, PANEL_SHARE = 2500, 0.95
NMS_IOU, POINT_GAP, GRID_CELL, EVAL_IOU = 0.7, 8.0, 4, 0.5
OVERRIDE_AT, CAPTION_WINDOW = 0.70, 2
SNIPPET, EVIDENCE, PROMPT_TEXT = 240, 300, 1500
CONF_HIGH, CONF_MEDIUM = 0.8, 0.5
PAGE_SIZE, PROMPT_POINTS, PROMPT_BOXES = 100, 48, 24
