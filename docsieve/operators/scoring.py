"""Checks of generated texts against their sources, and of parsed postings against expected ones.

Each check gives a score from 0 to 1 and whether it passed; sources of fewer than 50 letters are no ground to
judge on, so the checks that need one pass.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions import stats
from docsieve.functions import text as tx
from docsieve.sources.schemas import bound

LEAST_SOURCE = 50
# Our own lexicons; patterns keep to what RE2 also reads.
NUMBERS = (r"[0-9]+(?:[.][0-9]+)?%", r"[$€£][0-9][0-9,.]*[kmb]?", r"[0-9]+ (?:people|users|patients|projects|teams|sites|clients)", r"(?:by|over|about|up to) [0-9]+")
TECHNOLOGIES = ("python", "pyspark", "spark", "kubernetes", "javascript", "typescript", "react", "sql", "postgresql", "excel", "java", "docker", "go")
VERBS = ("led", "built", "improved", "designed", "authored", "managed", "reduced", "taught", "launched", "planned")
FILLER = ("and", "the", "for", "with", "years", "year", "experience", "strong", "good", "knowledge", "skills", "required", "preferred", "ability", "plus")
MUST, NICE = ("must_have", "hard", "required", "mandatory"), ("nice_to_have", "soft", "preferred", "optional")


def numbers(text: Column) -> Column:
    """Distinct percentages, amounts, counts of things and numbers in context."""
    low = F.lower(text)
    return F.array_distinct(F.concat(*[F.regexp_extract_all(low, F.lit(f"({p})"), 1) for p in NUMBERS]))


def technologies(text: Column, most: int = 15) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"\b({'|'.join(TECHNOLOGIES)})\b"), 1)
    return F.slice(F.array_distinct(found), 1, most)


def topic_words(text: Column) -> Column:
    """Words that aren't filler or numbers, three letters or more."""
    words = F.transform(F.split(text, r"[\s/,()]+"), lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z0-9+#.-]", "")))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*FILLER) & ~w.rlike("^[0-9]+[-+]?$"))


def meets(words: Column, text: Column) -> Column:
    """Any of one or two topic words, two of more; a requirement without any is met."""
    hits = F.size(F.filter(words, lambda w: F.contains(text, w)))
    return hits >= F.when(F.size(words) == 0, 0).when(F.size(words) <= 2, 1).otherwise(2)


def addressed(requirement: Column, text: Column) -> Column:
    """Whether a text meets a requirement, by its topic words, which are taken apart once."""
    return bound(topic_words(requirement), lambda words: meets(words, text))


def term_held(term: Column, text: Column) -> Column:
    parts = F.filter(F.split(term, r"[\s/,()-]+"), lambda w: F.length(w) > 2)
    return F.contains(text, term) | F.exists(parts, lambda w: F.contains(text, w))


def skill_held(skill: Column, text: Column) -> Column:
    parts = F.filter(F.split(skill, r"[\s/,()]+"), lambda w: F.length(w) > 2)
    return F.contains(text, skill) | F.exists(parts, lambda w: F.contains(text, w))


def judged(score: Column, passed: Column, hard: bool = False) -> Column:
    return F.struct(score.cast("double").alias("score"), passed.alias("passed"), F.lit(hard).alias("hard"))


def graded(score: Column, least: float, hard: bool = False) -> Column:
    """A score, computed once, that passes from ``least`` on."""
    return bound(score.cast("double"), lambda s: F.struct(s.alias("score"), (s >= least).alias("passed"), F.lit(hard).alias("hard")))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(1.0)


def counted(items: Column, good) -> Column:
    return F.size(F.filter(items, good))


def _needs_source(source: Column, score: Column) -> Column:
    return F.when(F.length(source) < LEAST_SOURCE, 1.0).otherwise(score)


def requirements_covered(requirements: Column, terms: Column, source: Column, made: Column) -> Column:
    """0.7 of the addressable requirements and 0.3 of the addressable terms that the text meets; 0.55 passes."""
    return words_covered(F.transform(requirements, topic_words), terms, source, made)


def words_covered(words: Column, terms: Column, source: Column, made: Column) -> Column:
    """``requirements_covered`` of requirements that are taken apart already, into arrays of their topic words."""
    short = F.length(source) < LEAST_SOURCE

    def both(of: Column) -> Column:
        asked, known = of["asked"], of["known"]
        met, held = counted(asked, lambda w: meets(w, made)), counted(known, lambda x: term_held(x, made))
        return F.when(F.size(asked) + F.size(known) > 0, share(met, F.size(asked)) * 0.7 + share(held, F.size(known)) * 0.3).otherwise(1.0)

    addressable = F.struct(F.filter(words, lambda w: short | meets(w, source)).alias("asked"), F.filter(terms, lambda x: short | term_held(x, source)).alias("known"))
    return graded(bound(addressable, both), 0.55)


def no_fabrication(skills: Column, source: Column) -> Column:
    return graded(_needs_source(source, share(counted(skills, lambda s: skill_held(s, source)), F.size(skills))), 0.85, hard=True)


def metrics_kept(source: Column, made: Column) -> Column:
    return graded(bound(numbers(source), lambda before: share(F.size(F.array_intersect(before, numbers(made))), F.size(before))), 0.3)


def word_count(made: Column, most: int = 800) -> Column:
    """1 up to ``most`` words, which passes, and less the more there are beyond."""
    return graded(bound(F.size(F.split(made, r"\s+")), lambda n: F.when(n <= most, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (n - most) / most))), 1.0)


def no_new_technologies(bullets: Column, source: Column) -> Column:
    held = bound(technologies(F.array_join(bullets, " \n "), 100), lambda named: share(counted(named, lambda x: F.contains(source, x)), F.size(named)))
    return graded(_needs_source(source, held), 1.0, hard=True)


def action_verb(bullet: Column) -> Column:
    """Whether a bullet begins with one of the verbs. A label before a colon, or in brackets, stands aside; "co-" and hyphens don't count."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(bullet), r"^[A-Z][A-Za-z .&'()-]*:\s+", ""), r"^\([^)]+\)[:,]?\s+", "")
    word = F.regexp_replace(F.lower(F.substring_index(F.regexp_replace(bare, r"\s", " "), " ", 1)), "[^a-z-]", "")
    return bound(word, lambda w: F.exists(F.array(w, F.replace(w, F.lit("-"), F.lit("")), F.regexp_replace(w, "^co-", "")), lambda v: v.isin(*VERBS)))


def action_verbs(bullets: Column) -> Column:
    return graded(share(counted(bullets, action_verb), F.size(bullets)), 0.5)


def structure(summary: Column, company: Column, title: Column, start: Column, skills: Column, bullets: Column) -> Column:
    """0.15 less for each section or field that is missing."""
    missing = [F.coalesce(c, F.lit("")) == "" for c in (summary, company, title, start)] + [F.size(skills) == 0, F.size(bullets) == 0]
    n = sum((m.cast("int") for m in missing[1:]), missing[0].cast("int"))
    return graded(F.greatest(F.lit(0.0), 1 - n * 0.15), 1.0)


def core_name(company: Column) -> Column:
    """What stands before a dash or comma, without the legal form."""
    head = F.trim(F.regexp_replace(F.lower(company), r"\s*[,–-].*$", ""))
    return F.trim(F.regexp_replace(head, r"\s+(corp|corporation|inc|llc|ltd|limited|gmbh|plc|co)\.?$", ""))


def facts_kept(company: Column, year: Column, source: Column) -> Column:
    name, core = F.trim(F.lower(company)), core_name(company)
    known = ((F.length(name) >= 3) & F.contains(source, name)) | ((F.length(core) >= 3) & F.contains(source, core))
    n = F.when(year.isNull(), 1).otherwise(2)
    right = known.cast("int") + F.coalesce(F.contains(source, year.cast("string")), F.lit(False)).cast("int")
    return graded(_needs_source(source, right / n), 0.85, hard=True)


def fuzzy_field(parsed: Column, expected: Column, threshold: float | Column) -> Column:
    """1 if equal, 0.9 if one holds the other, else the best of common words, edit distance and Jaro-Winkler."""
    p, e = F.trim(F.lower(F.coalesce(parsed, F.lit("")))), F.trim(F.lower(F.coalesce(expected, F.lit(""))))
    undecided = (p != "") & (e != "") & ~F.contains(p, e) & ~F.contains(e, p)
    words = [F.array_distinct(F.filter(F.split(x, r"[\s,/-]+"), lambda w: F.length(w) >= 2)) for x in (p, e)]
    common = F.coalesce(tx.jaccard(*words), F.lit(0.0))
    # The UDF sees undecided rows only; others reach it as nulls, which it skips.
    jw = stats.jaro_winkler_udf(F.when(undecided, p), F.when(undecided, e))
    best = F.greatest(common, tx.similarity(p, e), jw)
    score = F.when((p == "") & (e == ""), 1.0).when(e == "", 0.5).when(p == "", 0.0).when(p == e, 1.0).when(~undecided, 0.9).otherwise(best)
    return judged(score, (e == "") | ((p != "") & (~undecided | (best >= threshold))))


def numeric_field(parsed: Column, expected: Column, threshold: float = 0.8) -> Column:
    both, none = parsed.isNotNull() & expected.isNotNull(), parsed.isNull() & expected.isNull()
    near = both & (F.abs(parsed - expected) <= 1)
    score = F.when(none | (both & (parsed == expected)), 1.0).when(near, 0.8).otherwise(0.0)
    return graded(score, threshold)


def item_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\s/,()]+", text.lower(), flags=re.ASCII) if len(w) > 3]


def coded(lists: pa.Array) -> tuple[list[int], list[int], list]:
    """Of an array of lists: where each ends among all values, these as numbers of the distinct values (-1: null), and the distinct values, null last."""
    values, ends = lists.flatten().dictionary_encode(), np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
    return ends.tolist(), pc.fill_null(values.indices, -1).to_numpy(zero_copy_only=False).tolist(), [*values.dictionary.to_pylist(), None]


class Held(dict):
    """Whether an item shares words with each of some lower-case texts, by their numbers; a text is searched once.

    Two of the item's words stand in the text; of one or two, any (or all that there are).
    """

    def __init__(self, item: str | None, texts: list[str | None], any_of_two: bool = True):
        self.words, self.texts = None if item is None else item_words(item), texts
        self.least = (1 if len(self.words or ()) <= 2 else 2) if any_of_two else min(len(self.words or ()), 2)

    def __missing__(self, number: int) -> bool:
        text = self.texts[number]
        self[number] = found = None not in (self.words, text) and sum(w in text for w in self.words) >= self.least
        return found


def found_shares(items: pa.Array, others: pa.Array, any_of_two: bool) -> pa.Array:
    """``found_share`` of two arrays of lists; an item without words counts as found."""
    (ends, numbers, texts), (other_ends, other_numbers, other_texts) = coded(items), coded(others)
    lows, out, at, other_at = [x and x.lower() for x in other_texts], [], 0, 0
    held = [Held(x, lows, any_of_two) for x in texts]
    for end, other_end in zip(ends, other_ends):
        near, mine = other_numbers[other_at:other_end], [held[i] for i in numbers[at:end]]
        n = sum(h.words == [] or any(map(h.__getitem__, near)) for h in mine)
        out.append(n / len(mine) if mine else 1.0)
        at, other_at = end, other_end
    return pa.array(out, pa.float64())


@F.arrow_udf(T.DoubleType())
def _found_any(items: pa.Array, others: pa.Array) -> pa.Array:
    return found_shares(items, others, True)


@F.arrow_udf(T.DoubleType())
def _found_all(items: pa.Array, others: pa.Array) -> pa.Array:
    return found_shares(items, others, False)


def found_share(items: Column, others: Column, threshold: float, any_of_two: bool = True) -> Column:
    """The share of items of which another list holds one with the same words."""
    return graded((_found_any if any_of_two else _found_all)(items, others), threshold)


def normal_type(kind: str | None) -> str | None:
    low = kind and re.sub(r"[\s-]", "_", kind.lower(), flags=re.ASCII)
    return "must_have" if low in MUST else "nice_to_have" if low in NICE else low


@F.arrow_udf(T.DoubleType())
def _types_right(expected: pa.Array, kinds: pa.Array, parsed: pa.Array, parsed_kinds: pa.Array) -> pa.Array:
    (ends, numbers, texts), (other_ends, other_numbers, other_texts) = coded(expected), coded(parsed)
    want, got = ([names[i] for i in numbered] for _, numbered, values in map(coded, (kinds, parsed_kinds)) for names in [[normal_type(k) for k in values]])
    lows, out, at, other_at = [x and x.lower() for x in other_texts], [], 0, 0
    held = [Held(x, lows) for x in texts]
    for end, other_end in zip(ends, other_ends):
        near, hits, right = list(zip(other_numbers[other_at:other_end], got[other_at:other_end])), 0, 0.0
        for h, b in zip([held[i] for i in numbers[at:end]], want[at:end]):
            for number, a in near:
                if h[number]:
                    hits += 1
                    right += 1.0 if a is not None and a == b else 0.5 if (a, b) == ("must_have", "nice_to_have") else 0.0
                    break
        out.append(right / hits if hits else 1.0)
        at, other_at = end, other_end
    return pa.array(out, pa.float64())


def types_right(expected: Column, parsed: Column, threshold: float = 0.8) -> Column:
    """Of expected items with a parsed one, whose types agree; half for a wish that is read as a need.

    Both are arrays of ``text`` and ``type``; the first parsed item with the words counts.
    """
    return graded(_types_right(expected["text"], expected["type"], parsed["text"], parsed["type"]), threshold)
