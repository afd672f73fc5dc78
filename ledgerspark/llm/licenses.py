"""Licence scans: sparse TF-IDF cosine of sentences to licence templates, then inheritance from the nearest directory.

A text's sentences (cut at line ends and after . ! ?) that have a cue word are header candidates. Each distinct
candidate is a sparse TF-IDF vector, as are the templates; their cosine comes from a join on words. A file's own licence
is its best template at THRESHOLD or more. A licence file (by its name) gives its licence to its directory; files
without one of their own get that of the nearest directory above that has one, by a join of directories' ancestors with
the licensed directories. Directories are resolved, not files, so hot directories cost one row each. Only DataFrame
functions are used; only the vectors of the templates are broadcast (a fixed table).

Defined results: a null or empty text has no licence of its own; a null path is the empty path, in the root directory.
Rows of one path are one file, whose best sentence counts. Ties go to the template first by name, and in a directory to
the best score and then the first path. Empty tables give empty tables. Only path and text are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.6
#: Header forms of common licences, by their SPDX names.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
CUE, LICENSE_NAME = "licen[cs]e|copyright|spdx", r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$"
SENTENCE = r"\n|(?<=[.!?])[ \t\r]+"


def template_table(spark: SparkSession) -> tuple[DataFrame, float]:
    """word, license, idf and weight (of unit length) of the templates' words; the idf of words that no template has."""
    vectors = {k: re.findall("[a-z0-9]+", v.lower()) for k, v in TEMPLATES.items()}
    df = {w: sum(w in v for v in vectors.values()) for v in vectors.values() for w in v}
    idf = {w: math.log((1 + len(vectors)) / (1 + n)) + 1 for w, n in df.items()}
    rows = []
    for name, v in vectors.items():
        length = math.sqrt(sum((v.count(w) * idf[w]) ** 2 for w in sorted(set(v))))
        rows += [(w, name, idf[w], v.count(w) * idf[w] / length) for w in sorted(set(v))]
    return spark.createDataFrame(rows, "word string, license string, idf double, weight double"), math.log(1 + len(vectors)) + 1


def sentences(text: str = "text") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), SENTENCE), lambda x: F.trim(x)), lambda s: F.lower(s).rlike(CUE))


def matches(units: DataFrame) -> DataFrame:
    """unit, license, score of distinct sentences (unit) that match a template; one row each at most."""
    table, other = template_table(units.sparkSession)
    words = F.filter(F.split(F.lower("unit"), "[^a-z0-9]+"), lambda w: w != "")
    tf = units.select("unit", F.explode(words).alias("word")).groupBy("unit", "word").agg(F.count("*").alias("tf"))
    idf = table.select("word", "idf").distinct()
    tf = tf.join(F.broadcast(idf), "word", "left").select("unit", "word", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("x"))
    length = tf.groupBy("unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    dot = tf.join(F.broadcast(table.select("word", "license", "weight")), "word").groupBy("unit", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    score = dot.join(length, "unit").select("unit", "license", F.round(F.col("dot") / F.col("length"), 6).alias("score")).filter(F.col("score") >= THRESHOLD)
    return score.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("m")).select("unit", F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"))


def own(files: DataFrame) -> DataFrame:
    """path, license, score of files that have a licence of their own."""
    found = files.select("path", F.explode(F.array_distinct(sentences())).alias("unit"))
    best = found.join(matches(found.select("unit").distinct()), "unit")
    return best.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("m")).select("path", F.col("m.license").alias("own_license"), (-F.col("m.s")).alias("own_score"))


def directory(path: str = "path") -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame) -> DataFrame:
    """path, own_license, own_score, license, from_dir (of an inherited licence) and inherited for each file."""
    files = files.select(F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    mine = own(files)
    paths = files.select("path").distinct().withColumn("dir", directory())
    given = mine.filter(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_NAME)).withColumn("holder", directory())
    given = given.groupBy("holder").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("m")).select("holder", F.col("m.own_license").alias("given"))
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    dirs = paths.select("dir").distinct().withColumn("parts", parts)
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("parts", F.lit(1), k), "/").alias("holder")))).alias("a")).select("dir", "a.*")
    nearest = above.join(given, "holder").groupBy("dir").agg(F.max(F.struct("depth", "holder", "given")).alias("n")).select("dir", F.col("n.holder").alias("from_dir"), F.col("n.given").alias("given"))
    out = paths.join(mine, "path", "left").join(nearest, "dir", "left")
    inherited = F.col("own_license").isNull() & F.col("given").isNotNull()
    return out.select("path", "own_license", "own_score", F.coalesce("own_license", "given").alias("license"), F.when(inherited, F.col("from_dir")).alias("from_dir"), inherited.alias("inherited"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/thousand/doc_id.txt, and as source/lang/LICENSE.doc_id those that open with a cue."""
    opens = F.lower(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)).rlike(CUE)
    top = F.concat_ws("/", "source", "lang")
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    plain = F.concat_ws("/", top, F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(doc_id, F.lit(".txt")))
    return docs.select("doc_id", F.when(opens, F.concat(top, F.lit("/LICENSE."), doc_id)).otherwise(plain).alias("path"), "text")


def scan_documents(docs: DataFrame) -> DataFrame:
    """scan() of documents as files, with doc_id; files of several rows have one row for each."""
    files = document_files(docs)
    return files.select("doc_id", F.col("path").alias("p")).join(scan(files), F.col("p") == F.col("path")).drop("p")
