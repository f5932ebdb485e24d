"""Rules in order of priority: the first pattern that a text matches gives its label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """(pattern, label) pairs, and the label of a text that matches none; a null text has the default, too."""

    pairs: Sequence[tuple[str, str]]
    default: str

    def first(self, text: Column) -> Column:
        out = F.when(text.isNull(), self.default)
        for pattern, label in self.pairs:
            out = out.when(text.rlike(f"(?i){pattern}"), label)
        return out.otherwise(self.default)

    def every(self, text: Column) -> Column:
        """All labels that match, in order."""
        found = [F.when(text.rlike(f"(?i){pattern}"), F.lit(label)) for pattern, label in self.pairs]
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    def sql(self, text: str) -> str:
        cases = " ".join(f"WHEN regexp_matches({text}, '(?i){p}') THEN '{label}'" for p, label in self.pairs)
        return f"CASE WHEN {text} IS NULL THEN '{self.default}' {cases} ELSE '{self.default}' END"

    def sql_every(self, text: str) -> str:
        cases = ", ".join(f"CASE WHEN regexp_matches({text}, '(?i){p}') THEN '{label}' END" for p, label in self.pairs)
        return f"concat_ws(',', {cases})"


# Our own lexicons, over the words of the stand-in tables.
DOMAIN = Rules([("ring|bolt", "hardware"), ("gear|gizmo", "machinery"), ("widget", "software")], "general")
CATEGORY = Rules([("hot|red", "warm"), ("blue|cold", "cool"), ("small|large", "sized")], "other")
TIER = Rules([("^red", "license"), ("^blue", "education"), ("^hot", "voluntary"), ("gizmo$", "certification")], "core_skill")
CERT_TIER = Rules([("ring$", "professional"), ("bolt$", "gold")], "voluntary")
ISSUER = Rules([("widget", "Board of Widgets"), ("gear", "Guild of Gears")], "unknown")
SENIORITY = Rules([("URGENT", "director"), ("HIGH", "lead"), ("MEDIUM", "senior"), ("NOT SPECIFIED", "mid")], "entry")
TRAINING = Rules([("LOW", "training")], "regular")
STAGE = Rules([("URGENT|HIGH", "leadership"), ("MEDIUM", "growth")], "early")
COUNTRY = Rules([("_(1|2|3)$", "north"), ("_1[0-9]$", "south"), ("_2", "east")], "west")
ROLE_DOMAIN = Rules([("MACHINERY", "engineering"), ("BUILDING|FURNITURE", "construction"), ("AUTOMOBILE", "transport")], "home")
SKILL_KIND = Rules([("ring", "language"), ("bolt", "framework"), ("gear", "infrastructure"), ("gizmo", "database")], "tool")
INTENT = Rules(
    [("idiot|stupid|trash", "complaint"), ("[?]", "question"), ("[0-9]{2,}", "correction"), ("!", "praise")], "unclear"
)
INDUSTRY = Rules([("^MACH", "industry"), ("^AUTO", "mobility"), ("^(BUILD|FURN)", "real estate")], "consumer")
LINE_KIND = Rules([("^[#*-]", "bullet"), ("^[0-9]+[.)]", "numbered"), (":$", "header"), ("[.!?]$", "sentence")], "fragment")
