"""Patterns and word lists of the two manual dialects.

They are written for any of Java's, Python's and RE2's engines; ``java`` adds the flags
that make Java's classes Unicode-aware and ``.`` stop at line feeds alone.
"""

from __future__ import annotations

from dataclasses import dataclass


def java(pattern: str) -> str:
    return "(?Ud)" + pattern


# --- fixed values: line shapes, phrases, units and names that documents are written with ---

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
FILE_URL = r"file:///[^\n]+"
ANY_URL = r"file:///[^\n]+|https?://\S+"
PAGE_STAMP = r"2014 F-150 Workshop Manual\s+Page\s+\d+\s+sur\s+\d+\s*"
REVISION_DATE = r"Procedure revision date:\s*[\d/]+\s*"
SECTION_DATE = r"(SECTION\s+[\d\-]+:[^\n]+?)\s+\d{4}-\d{2}-\d{2}\s*"
MANY_SPACES = r"[ \t]{3,}"
MANY_LINES = r"\n{4,}"
PAGE = r"^<<PAGE\s+(\d+)>>$"

SECTION = r"(?i)^SECTION\s+([\d\-]+[A-Z]?):\s*(.+?)(?:\s+2014 F-150 Workshop Manual)?$"
SUBSECTION = (
    r"(?i)^(DIAGNOSIS AND TESTING|DESCRIPTION AND OPERATION|GENERAL PROCEDURES|"
    r"REMOVAL AND INSTALLATION|DISASSEMBLY AND ASSEMBLY|SPECIFICATIONS|"
    r"INSPECTION AND VERIFICATION|ADJUSTMENTS|COMPONENT TESTS|"
    r"PINPOINT TEST)(?:\s+Procedure revision date:\s*[\d/]+)?\s*$"
)
TABLE_HEADER = r"(?i)^(?:Description\s+)?Nm\s+lb[-‑–]ft(?:\s+lb[-‑–]in)?\s*$|^(?:Description\s+)?Nm\s+lb[-‑–]in\s*$"
WARNING = r"(?i)^(WARNING|NOTICE|NOTE)\b"
STEP = r"^\d{1,2}\.\s+"
BULLET = r"^z\s+|^•\s+|^-\s+"

CELL = r"[\d\.]+(?:\s*[-—–]\s*[\d\.]+)?|[—–-]"
ROW = rf"^(.+?)\s+({CELL})\s+({CELL})\s+({CELL})\s*$"
NOT_ROW = r"(?i)^(Description|SECTION|SUBSECTION|Torque Spec|NOTE|WARNING|NOTICE|file://|2014 F-150|\d{4}-\d{2}-\d{2}|Page\s+\d)"
VALUE = r"(?i)^(?:[\d\.]+(?:\s*[-—–]\s*[\d\.]+)?|[—–-]|N/A)$"
RANGE = r"^([\d\.]+)\s*[-—–]\s*([\d\.]+)$"

TORQUE = r"(?i)(.{0,120}?)([\d\.]+)\s*Nm\s*\(([\d\.]+)\s*(lb-ft|lb-in)\)(.{0,60})"
STAGE = r"(?i)Stage\s+(\d)\s*:.*?([\d\.]+)\s*Nm\s*\(([\d\.]+)\s*(lb-ft|lb-in)\)"
DIMENSION = r"(?i)([\d\.]+)\s*mm\s*\(([\d\.]+)\s*in\)"
BEFORE_TO = r"(?i)(.{3,50}?)\s+to\s+[\d\.]+\s*Nm"
VERB_FIRST = r"(?i)^(install|tighten|torque|apply|check|ensure)"
LINE_MARK = r"^z\s+|^\d+\.\s+"

GENERIC_SECTION = r"(?i)^SECTION\s+([\w\-]+):\s*(.+)$"
CODE_SECTION = r"^([A-Z]{1,4}[-–]\d+[A-Z]?)\s{2,}(.+)$"
GENERIC_SUBSECTION = (
    r"(?i)^(?:SPECIFICATIONS?|DIAGNOSIS AND TESTING|DESCRIPTION AND OPERATION|"
    r"REMOVAL AND INSTALLATION|DISASSEMBLY AND ASSEMBLY|GENERAL PROCEDURES?|"
    r"SERVICE SPECIFICATIONS?|INSPECTION AND VERIFICATION|ADJUSTMENTS?|"
    r"TORQUE SPECIFICATIONS?|FASTENER SPECIFICATIONS?|TIGHTENING TORQUES?)\s*$"
)
GENERIC_WARNING = r"(?i)^(WARNING|NOTICE|NOTE|CAUTION)\b"
GENERIC_BULLET = r"^[z•\-\*]\s+"
ALL_CAPS = r"^([A-Z][A-Z\s/&,()\-]{2,58})$"
UNIT_TOKEN = r"(?i)(N[·.]?m|kgf[·.]?cm|ft[·.]?lb[fs]?|lb[·.]?ft|lb[·.]?in|in[·.]?lb|ft[·.]?lbf|lbf[·.]?in|kN[·.]?m)"
GENERIC_CELL = r"[\d,]+(?:\.\d+)?(?:\s*[-–]\s*[\d,]+(?:\.\d+)?)?|[-–]"
GENERIC_ROW = rf"^(.+?)\s+({GENERIC_CELL})\s+({GENERIC_CELL})(?:\s+({GENERIC_CELL}))?\s*$"
GENERIC_NOT_ROW = r"(?i)^(?:SECTION|Note|WARNING|NOTICE|file://|\d{4}-\d{2}-\d{2}|Page\s)"
GENERIC_VALUE = r"(?i)^(?:[\d.]+(?:\s*[-–]\s*[\d.]+)?|[-–]|N/A)$"
GENERIC_RANGE = r"^([\d.]+)\s*[-–]\s*([\d.]+)$"
GENERIC_NUMBER = r"[\d,]+\.?\d*(?:\s*[-–]\s*[\d,]+\.?\d*)?"
GENERIC_TORQUE = (
    rf"(?i)([^.]{{0,120}}?)({GENERIC_NUMBER})\s*(N[·.]?m|Nm)"
    rf"(?:\s*\(({GENERIC_NUMBER})\s*(kgf[·.]?cm|kgf\.cm|kgf·cm)(?:,\s*({GENERIC_NUMBER})\s*(ft[·.]?lbf?|lb[·.]?ft))?\))?"
    rf"(?:\s*\(({GENERIC_NUMBER})\s*(lb[·.]?ft|lb[·.]?in|ft[·.]?lb[fs]?)\))?"
)
GENERIC_STAGE = r"(?i)Stage\s+(\d)\s*:.*?([\d,]+\.?\d*)\s*(N[·.]?m|Nm)(?:\s*\(([\d,]+\.?\d*)\s*(lb[·.]?ft|ft[·.]?lbf?|kgf[·.]?cm)\))?"
GENERIC_BEFORE_TO = r"(?i)(.{3,50}?)\s+to\s+[\d,\.]+\s*N[·.]?m"
GENERIC_VERB_FIRST = r"(?i)^(install|tighten|torque|apply|check)"
GENERIC_LINE_MARK = r"^[z•\-\*]\s+|^\d+\.\s+"
TABLE_CELL_UNIT = r"(?i)\b(?:N[·.]?m|Nm|kgf[·.]?cm|ft[·.]?lbf?|lb[·.]?ft|lb[·.]?in)\b"

TRIM = r"\b(SVT Raptor|Raptor|FX4|Lariat|Platinum|Limited|King Ranch|Tremor|STX|XLT)\b"
PHRASE = (
    r"(?i)(?:not\s+tighten|tighten|install|remove|torque)\s+(?:the\s+)?([a-zA-Z][a-zA-Z\s]{2,30}?"
    r"(?:nut|bolt|screw|rod|arm|bar|bearing|mount|plate|bracket|sensor|pin|shaft|cap|stud|assembly|link)s?)\b"
)
PARENTHESIS = r"\(([A-Za-z][^)]{2,39})\)"
SPEC_TYPES = ["torque_table_row", "inline_torque", "multi_stage_torque", "dimensional_spec"]
SPEC_NAMES = {"torque_table_row": "Torque", "multi_stage_torque": "Torque", "dimensional_spec": "Dimension", "inline_torque": "Torque"}

FALLBACK_TORQUE = r"(?i)([\d,]+\.?\d*(?:\s*[-–]\s*[\d,]+\.?\d*)?)\s*(N[·.]?m|Nm)(?:\s*\(([\d,]+\.?\d*)\s*(kgf[·.]?cm|lb[·.]?ft|ft[·.]?lbf?|lb[·.]?in)\))?"
FALLBACK_LBFT = r"(?i)([\d,]+\.?\d*(?:\s*[-–]\s*[\d,]+\.?\d*)?)\s*(lb[·.\-]?ft|ft[·.\-]?lb[sf]?)"
QUERY_HEAD = r"(?i)^(what is|what('s| is) the|torque for|tighten|spec|specification|find|give me|tell me)\s+"
QUERY_TAIL = r"(?i)\s+(torque|spec|specification|value)$"
UNIT_ALIASES = {
    "nm": "Nm", "n·m": "Nm", "n.m": "Nm", "newton metres": "Nm", "newton meters": "Nm", "n-m": "Nm",
    "lb-ft": "lb-ft", "lbft": "lb-ft", "ft-lb": "lb-ft", "foot pounds": "lb-ft", "foot-pounds": "lb-ft",
    "lb-in": "lb-in", "lbin": "lb-in", "in-lb": "lb-in", "inch pounds": "lb-in",
    "mm": "mm", "millimetres": "mm", "millimeters": "mm",
    "in": "in", "inches": "in", "inch": "in",
    "degrees": "degrees", "deg": "degrees", "°": "degrees",
}
TOKEN = r"[a-z0-9]+"

# --- end of fixed values ---


@dataclass(frozen=True)
class Dialect:
    """What differs between the manual-specific and the generic reading of a document."""

    name: str
    sections: tuple[str, ...]
    subsection: str
    warning: str
    bullet: str
    not_row: str
    value: str
    range: str
    verb_first: str
    before_to: str
    line_mark: str
    paragraphs: int


WORKSHOP = Dialect("workshop", (SECTION,), SUBSECTION, WARNING, BULLET, NOT_ROW, VALUE, RANGE, VERB_FIRST, BEFORE_TO, LINE_MARK, 100)
GENERIC = Dialect("generic", (GENERIC_SECTION, CODE_SECTION), GENERIC_SUBSECTION, GENERIC_WARNING, GENERIC_BULLET, GENERIC_NOT_ROW, GENERIC_VALUE, GENERIC_RANGE, GENERIC_VERB_FIRST, GENERIC_BEFORE_TO, GENERIC_LINE_MARK, 200)
