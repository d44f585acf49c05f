"""Licence scans: TF-IDF cosine of statements, headers and licence files to templates, then inheritance from the nearest directory.

Built from DataFrame functions alone. A text is cut into sentences (at line ends, and at white space after ``.``, ``!`` and ``?``)
and into blocks of several lines (at empty lines), so that a statement is found within a line, and a wrapped header or a
paragraph of a licence as a whole. Those that hold a cue are compared: every template holds one, and texts without a
cue, most of a corpus, are passed over by one regular expression.

Terms are ``[a-z0-9]+``, version numbers with their dots. Their weight is the count times an inverse document frequency over the
templates, which is fixed: what else a table holds changes no file's licence. Terms of no template weigh ``UNKNOWN``. The sparse
vectors are exploded to (statement, term, weight) rows, joined with the templates' rows, a broadcast of fixed size, and
summed to cosines. The best template of at least ``threshold`` is the text's own licence. A sentence with an SPDX
identifier states its licence expression with a score of 1, whether or not there is a template of it.

A licence file is one with a licence file's name, or whose statement makes at least half of its terms. Its licence
holds for its directory and those below, unless a nearer directory has one: the distinct directories look up
their ancestors by equi-joins on paths, and files join their own directory's answer.

Defined cases: null or empty texts state nothing but inherit; files without a path inherit nothing; of several licence
files in one directory the most similar counts, then the first path; repeated rows each get an answer; an empty table
yields no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import materialize
from gristmill.llm.decontaminate import let
from gristmill.llm.license_texts import CUES, FILE_NAMES, IDENTIFIERS, TEMPLATES

_ID = "[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?"
SPDX = rf"(?:^|[^A-Za-z0-9])(?i:SPDX-License-Identifier)[ \t]*:[ \t]*(\(*{_ID}\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*{_ID}\)*)*)"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
CUE = "|".join([*CUES, "spdx"])
#: Weight of a term that no template holds, such as that of a term of a third of the templates.
UNKNOWN = 2.0
SALTS = 16


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def idf() -> dict[str, float]:
    """Inverse document frequency of each template term over the templates."""
    held = Counter(t for _, text in TEMPLATES for t in set(terms_of(text)))
    return {t: math.log((len(TEMPLATES) + 1) / (n + 1)) + 1.0 for t, n in held.items()}


def template_rows(spark: SparkSession) -> DataFrame:
    """term, idf, uses (template, share: its weight over the template's length) for every template term, from a literal."""
    weight, uses = idf(), {}
    for number, (_, text) in enumerate(TEMPLATES):
        own = {t: n * weight[t] for t, n in Counter(terms_of(text)).items()}
        length = math.sqrt(sum(w * w for w in own.values()))
        for t, w in own.items():
            uses.setdefault(t, []).append({"template": number, "share": w / length})
    rows = [{"term": t, "idf": weight[t], "uses": u} for t, u in sorted(uses.items())]
    kind = "array<struct<term:string,idf:double,uses:array<struct<template:int,share:double>>>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("r")).select("r.*")


def statements(text: Column) -> Column:
    """Sentences, and blocks of several lines, that hold a cue."""
    sentences = F.split(F.regexp_replace(text, r"([.!?])[ \t\r]+", "$1\n"), "\n")
    blocks = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda b: F.contains(b, F.lit("\n")))
    return F.filter(F.concat(sentences, blocks), lambda u: F.lower(u).rlike(CUE))


def spdx(line: Column) -> Column:
    """The licence expression of a line's SPDX identifier in the templates' spelling, or an empty string."""
    spelt = F.create_map(*[F.lit(x) for name in IDENTIFIERS for x in (name.lower(), name)])
    return let(F.regexp_extract(line, SPDX, 1), lambda found: F.coalesce(F.try_element_at(spelt, F.lower(found)), found))


def best_licenses(stated: DataFrame, threshold: float) -> DataFrame:
    """rid, own_license, score, size of the best statement of each row; stated: rid, u, statement."""
    spark = stated.sparkSession
    read = materialize(stated.select("rid", "u", spdx(F.col("statement")).alias("named"), terms("statement").alias("terms")), "read")
    counted = read.filter("named = ''").select("rid", "u", F.size("terms").alias("size"), F.explode("terms").alias("term")).groupBy("rid", "u", "size", "term").agg(F.count(F.lit(1)).alias("c"))
    weighed = counted.join(F.broadcast(template_rows(spark)), "term", "left").withColumn("x", F.col("c") * F.coalesce("idf", F.lit(UNKNOWN)))
    weighed = materialize(weighed.select("rid", "u", "size", "x", "uses"), "weighed")
    lengths = weighed.groupBy("rid", "u", "size").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    dots = weighed.select("rid", "u", "x", F.explode("uses").alias("t")).groupBy("rid", "u", "t.template").agg(F.sum(F.col("x") * F.col("t.share")).alias("dot"))
    names = F.array(*[F.lit(name) for name, _ in TEMPLATES])
    scored = dots.join(lengths, ["rid", "u"]).select("rid", F.round(F.col("dot") / F.col("length"), 9).alias("score"), F.get(names, F.col("template")).alias("name"), "size")
    scored = scored.filter(F.col("score") >= threshold).unionByName(read.filter("named <> ''").select("rid", F.lit(1.0).alias("score"), F.col("named").alias("name"), F.size("terms").alias("size")))
    best = scored.groupBy("rid").agg(F.min(F.struct((-F.col("score")).alias("s"), "name", (-F.col("size")).alias("size"))).alias("b"))
    return best.select("rid", F.col("b.name").alias("own_license"), (-F.col("b.s")).alias("score"), (-F.col("b.size")).alias("size"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = 0.6, carry: list[str] | None = None) -> DataFrame:
    """The carried columns, path, own_license, score, license, license_from of every file."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    told = F.lower(text).rlike(CUE)
    carried = carry or []
    rows = files.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)], F.col(path_col).alias("path"), F.when(told, statements(text)).alias("statements"), F.when(told, F.size(terms(text))).alias("n_terms"))
    rows = rows.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")))
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "statements")  # the texts are read once
    own = best_licenses(rows.filter("size(statements) > 0").select("rid", F.posexplode("statements").alias("u", "statement")), threshold)
    base = materialize(rows.drop("statements").join(own, "rid", "left"), "own")
    stem = F.lower(F.regexp_extract("path", r"([^/.]*)(?:\.[^/]*)?$", 1))
    whole = 2 * F.col("size") >= F.col("n_terms")
    granting = base.filter(F.col("own_license").isNotNull() & F.col("dir").isNotNull() & (stem.isin(FILE_NAMES) | whole))
    grants = granting.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own_license")).alias("g")).select("dir", F.col("g.own_license").alias("given"))
    dirs = base.select("dir").filter("dir is not null").distinct()
    parts = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up")))).alias("a"))
    nearest = ancestors.select("dir", "a.depth", "a.up").join(grants.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "given")).alias("n"))
    # a directory may hold a third of all files: its files are dealt over SALTS keys, its answer goes to each
    answers = nearest.select("dir", F.col("n.up").alias("up"), F.col("n.given").alias("given"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = base.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(answers, ["dir", "salt"], "left")
    return out.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)],
        "path",
        "own_license",
        F.when(F.col("own_license").isNotNull(), F.col("score")).alias("score"),
        F.coalesce("own_license", "given").alias("license"),
        F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("up")).alias("license_from"),
    )
