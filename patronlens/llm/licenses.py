"""Licence scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority.

A text becomes its words in lower case, each between two blanks of its own; so a rule matches whole
words, two matches never share a blank, and half the blanks before a match are its word number. A rule
runs only on texts that hold its keyword. Of the detections, one whose interval lies within the interval of another
of no lower priority is suppressed; of equal intervals the higher priority, then the first label, stays.

Everything happens inside the row, in built-in functions: no join, no shuffle, no Python on the executors.

Nulls: a null text has no words and no detections. Ids may be null or repeated; rows stay separate.
Texts of any length are searched whole. Columns that are not asked for are ignored.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.llm.license_rules import PRIORITY, Rule, all_rules

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Parts of words that most rules need; what has none of them is passed over after these searches.
ROOTS = ("licen", "gpl", "perm", "copy", "distribut", "warrant", "merchant", "commercial", "commons", "public", "rights", "org", "without", "software", "mpl", " cc ")
LEVELS = max(PRIORITY.values()) + 1
DETECTION = "array<struct<first:bigint,last:bigint,label:string,kind:string,weight:int,kept:boolean>>"


def spaced(text: Column) -> Column:
    """Words in lower case, each with a blank before and behind, and one more blank at either end."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), SEPARATORS, "  ")


def signature(rule: Rule) -> str:
    """The rule over spaced words: every blank is two, one behind a word and one before the next."""
    doubled = rule.regex.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")
    return f" (?:{doubled}) "


def keyword(rule: Rule) -> str:
    """Short words count as whole words only, as they are part of many others."""
    inner = rule.keyword.replace(" ", "  ")
    return f" {inner} " if len(inner) <= 3 else inner


def _words(column: Column) -> Column:
    """Words in a part of a spaced text; a single blank at an end does not matter."""
    return ((F.length(column) - F.length(F.replace(column, F.lit(" "), F.lit("")))) / 2).cast("long")


def needs(rule: Rule, part: str) -> bool:
    """Whether every match of the rule holds ``part``: it stands in its keyword, or outside of alternatives and options."""
    left, before = rule.regex, None
    while left != before:
        before = left
        left = re.sub(r"\([^()]*\)\?", " ", left)
        left = re.sub(r"\(([^()|]*)\)(?![?{])", r"\1", left)
    plain = re.sub(r"\([^()]*\)", " ", left)
    return part in keyword(rule) or ("|" not in plain and part in plain)


def root(rule: Rule) -> str:
    """The first of ``ROOTS`` that every match holds, else the keyword."""
    return next((part for part in ROOTS if needs(rule, part)), keyword(rule))


def _rule_groups(rules: list[Rule]) -> Column:
    """Rules by keyword, and keywords by root: a text is searched for the few roots first."""
    groups: dict[str, dict[str, list[Rule]]] = {}
    for rule in rules:
        groups.setdefault(root(rule), {}).setdefault(keyword(rule), []).append(rule)

    def one(r: Rule) -> Column:
        values = {"regex": signature(r), "label": r.label, "kind": r.kind, "priority": r.priority, "weight": r.weight}
        return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])

    def keywords(some: dict[str, list[Rule]]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*map(one, r)).alias("rules")) for k, r in some.items()])

    return F.array(*[F.struct(F.lit(k).alias("root"), keywords(some).alias("keywords")) for k, some in groups.items()])


def _places(text: Column, rule: Column) -> Column:
    """First and last word of every match of a rule."""
    lengths = F.transform(F.regexp_extract_all(text, rule["regex"], F.lit(0)), _words)
    gaps = F.transform(F.split(text, rule["regex"], -1), _words)
    matches = F.filter(F.arrays_zip(gaps.alias("gap"), lengths.alias("size")), lambda m: m["size"].isNotNull())
    empty = F.array().cast("array<struct<first:bigint,last:bigint>>")

    def add(done: Column, match: Column) -> Column:
        first = done["at"] + match["gap"]
        at = first + match["size"]
        place = F.struct(first.alias("first"), (at - 1).alias("last"))
        return F.struct(at.alias("at"), F.concat(done["out"], F.array(place)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
    found = F.aggregate(matches, start, add, lambda done: done["out"])
    return F.when(F.rlike(text, rule["regex"]), found).otherwise(empty)


def _detections(text: Column, rules: list[Rule]) -> Column:
    def of_rule(rule: Column) -> Column:
        return F.transform(
            _places(text, rule),
            # Sorts by place, the longer and then the more important first.
            lambda p: F.struct(
                p["first"].alias("first"),
                (-p["last"]).alias("before"),
                (-rule["priority"]).alias("rank"),
                rule["label"].alias("label"),
                rule["kind"].alias("kind"),
                rule["weight"].alias("weight"),
            ),
        )

    near = F.flatten(F.transform(F.filter(_rule_groups(rules), lambda g: F.contains(text, g["root"])), lambda g: g["keywords"]))
    gated = F.filter(near, lambda g: F.contains(text, g["keyword"]))
    chosen = F.flatten(F.transform(gated, lambda g: g["rules"]))
    return F.array_sort(F.flatten(F.transform(chosen, of_rule)))


def _resolve(detections: Column) -> Column:
    """Marks what stays; ``ends[p]`` is the furthest word of any earlier detection of priority p."""
    start = F.struct(
        F.array_repeat(F.lit(-1).cast("long"), LEVELS).alias("ends"), F.array().cast(DETECTION).alias("out")
    )

    def add(done: Column, d: Column) -> Column:
        last, priority = -d["before"], -d["rank"]
        ends = F.transform(done["ends"], lambda e, i: F.when(i == priority, F.greatest(e, last)).otherwise(e))
        inside = F.exists(F.slice(done["ends"], priority + 1, F.lit(LEVELS)), lambda e: e >= last)
        row = F.struct(
            d["first"].alias("first"),
            last.alias("last"),
            d["label"].alias("label"),
            d["kind"].alias("kind"),
            d["weight"].cast("int").alias("weight"),
            (~inside).alias("kept"),
        )
        return F.struct(ends.alias("ends"), F.concat(done["out"], F.array(row)).alias("out"))

    return F.aggregate(detections, start, add, lambda done: done["out"])


def scan_licenses(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), text_column: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``columns`` of every document, ``n_words`` and ``detections`` (words first..last, label, kind, weight, kept)."""
    chosen = all_rules() if rules is None else rules
    names = [f"c{i}" for i in range(len(columns))]
    spaced_text = docs.select(*[F.col(c).alias(n) for c, n in zip(columns, names)], spaced(F.col(text_column).cast("string")).alias("words"))
    found = spaced_text.select(*names, (_words(F.col("words")) - 1).alias("n_words"), _detections(F.col("words"), chosen).alias("found"))
    return found.select(*[F.col(n).alias(c) for c, n in zip(columns, names)], "n_words", _resolve(F.col("found")).alias("detections"))


def summary(scanned: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, places and labels per document; the score is the weight of the best detection that stays."""
    found = F.col("detections")
    base = F.filter(found, lambda d: d["kind"] == "base")
    stay = F.filter(found, lambda d: d["kept"])

    def labels(some: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda d: d["label"]))), ",")

    return scanned.select(
        *columns,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.concat(base, stay)).alias("labels"),
        F.coalesce(F.array_max(F.transform(stay, lambda d: d["weight"])) / 100, F.lit(0.0)).alias("score"),
    )
