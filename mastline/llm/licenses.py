"""License scan of files: TF-IDF cosine to templates, then inheritance along
directories; built-in functions only.

Templates are few and given as a parameter, so their words and weights are
literals of the plan. Word weights come from all files. Notices are compared
with single lines and with runs of as many words, wherever lines break; full
license texts with whole files. A file that is like a full text has that
license, any other that of its best line or run; a file that is mostly a
license text is the license file of its directory, and files without a license
of their own take that of the nearest directory above.
"""

from __future__ import annotations

import math
from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastline.llm.tables import cut

#: Least cosine of a match, and least share of a file's words in matching lines to be a license file.
LIKENESS, WHOLE = 0.6, 0.5
#: Notices of common licenses (fixed values).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Full license texts, compared with whole files (fixed values).
TEXTS: tuple[tuple[str, str], ...] = tuple(
    (name, resources("mastline.llm").joinpath("license_texts", f"{name}.txt").read_text("utf-8"))
    for name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0"))
#: Marks that do not belong to a word they stand around.
MARKS = ".,;:!?()[]{}<>\"'`#*/\\|=-"


def _terms(text: Column) -> Column:
    """Lower-cased words without the marks around them. Splitting at one fixed
    character is Spark's fast path, so other white space becomes that first."""
    plain = F.lower(text)
    for space in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    return F.filter(F.transform(F.split(plain, " "), lambda w: F.trim(w, F.lit(MARKS))), lambda w: w != "")


def _template_words(text: str) -> list[str]:
    return [w for w in (w.strip(MARKS) for w in text.lower().split()) if w]


def _template_terms(text: str) -> dict[str, int]:
    words = _template_words(text)
    return {w: words.count(w) for w in words}


def _literal(words) -> Column:
    """An array of words as one literal."""
    return F.split(F.lit(" ".join(words)), " ")


def term_weights(files: DataFrame, templates=TEMPLATES, texts=()) -> tuple[dict[str, float], float]:
    """Inverse document frequency of every word of the templates and full texts
    over all files, and the mean of the templates' words, which stands for any
    other word. The counts that reach the driver are one per such word."""
    notices = {w for _, t in templates for w in _template_terms(t)}
    vocabulary = sorted(notices | {w for _, t in texts for w in _template_terms(t)})
    counts = files.select(F.explode(F.array_intersect(_terms(F.col("text")), _literal(vocabulary))).alias("w")).groupBy("w").count()
    df, n = {r["w"]: r["count"] for r in counts.collect()}, files.count()
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    return idf, sum(idf[w] for w in sorted(notices)) / max(1, len(notices))


def _gate(templates: list[dict[str, float]]) -> list[str]:
    """Words of which a line needs one to reach the threshold: the rest of any
    template has too little weight, so no match is lost."""
    chosen: set[str] = set()
    for weights in templates:
        norm, rest = sum(w * w for w in weights.values()), 0.0
        for word, w in sorted(weights.items(), key=lambda kv: kv[1]):
            rest += w * w
            if rest >= (LIKENESS * LIKENESS - 1e-9) * norm:
                chosen.add(word)
    return sorted(chosen)


def _best(names: list[str], norms: list[float]) -> Column:
    """Best (score, license) of the sums ``dot0``, ``dot1``, ... and ``norm``."""
    return F.greatest(*(F.struct(F.round(F.col(f"dot{k}") / F.sqrt("norm") / norms[k], 6).alias("score"), F.lit(name).alias("license"))
                        for k, name in enumerate(names)))


def _windows(files: DataFrame, templates, gate: list[str]) -> DataFrame:
    """Runs of words to compare: for every word of the gate, the run of a
    template's length that has it where the template has it. A notice that is
    wrapped, or inside a longer line, is one of them whole."""
    places: dict[str, set[tuple[int, int]]] = {w: set() for w in gate}
    for words in {tuple(_template_words(t)) for _, t in templates}:
        for k, w in enumerate(words):
            if w in places:
                places[w].add((k, len(words)))
    known = F.array(*map(F.lit, gate))
    at = F.create_map(*(x for w in gate for x in (F.lit(w), F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in sorted(places[w]))))))
    held = files.withColumn("terms", _terms(F.col("text"))).where(F.arrays_overlap("terms", known))
    hits = F.filter(F.transform("terms", lambda w, p: F.struct(p.alias("p"), w.alias("w"))), lambda h: F.array_contains(known, h["w"]))
    runs = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.try_element_at(at, h["w"]), lambda o: F.struct(
        F.greatest(h["p"] - o["k"], F.lit(0)).alias("start"), o["n"].alias("n"))))))
    held = held.select("path", F.xxhash64("text").alias("text_key"), F.size("terms").alias("file_terms"), "terms", F.explode(runs).alias("run"))
    return held.select("path", "text_key", "file_terms", F.lit(-1).alias("line_no"), F.col("run.start").alias("start"),
                       F.slice("terms", F.col("run.start") + 1, F.col("run.n")).alias("terms"))


def line_matches(files: DataFrame, templates=TEMPLATES, weighed: tuple[dict[str, float], float] | None = None) -> DataFrame:
    """(path, text_key, file_terms, line_no, start, n_terms, license, score): best
    template of each line and run of words that reaches the threshold. A line's
    ``start`` and a run's ``line_no`` are -1; a run's ``start`` counts words."""
    idf, other = weighed or term_weights(files, templates)
    counted = [_template_terms(t) for _, t in templates]
    idf = {w: idf[w] for w in sorted({w for c in counted for w in c})}
    weights = [{w: n * idf[w] for w, n in c.items()} for c in counted]
    gate = _gate(weights)
    lines = files.select("path", F.xxhash64("text").alias("text_key"), F.size(_terms(F.col("text"))).alias("file_terms"),
                         F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("path", "text_key", "file_terms", "line_no", F.lit(-1).alias("start"), _terms(F.col("line")).alias("terms"))
    lines = lines.where(F.arrays_overlap("terms", F.array(*map(F.lit, gate)))).unionByName(_windows(files, templates, gate))
    line = ["path", "text_key", "file_terms", "line_no", "start", "n_terms"]
    words = lines.withColumn("n_terms", F.size("terms")).select(*line, F.explode("terms").alias("w")).groupBy(*line, "w").agg(F.count("*").alias("tf"))
    # The templates' words as columns: one map per template, bounded by the parameter.
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in idf.items() for x in kv)), F.col("w")), F.lit(other)) * F.col("tf")
    sums = [F.sum(F.pow("x", F.lit(2.0))).alias("norm")]
    for k, t in enumerate(weights):
        term = F.try_element_at(F.create_map(*(F.lit(x) for kv in t.items() for x in kv)), F.col("w"))
        sums.append(F.sum(F.coalesce(term, F.lit(0.0)) * F.col("x")).alias(f"dot{k}"))
    scored = words.withColumn("x", weight).groupBy(*line).agg(*sums)
    norms = [math.sqrt(sum(v * v for v in t.values())) for t in weights]
    best = _best([name for name, _ in templates], norms)
    return scored.withColumn("best", best).where(F.col("best.score") >= LIKENESS).select(*line, "best.license", "best.score")


def whole_matches(files: DataFrame, texts, idf: dict[str, float], other: float) -> DataFrame:
    """(path, text_key, license, score): best full text of each whole file that reaches the threshold.

    A cosine is at most the share of the text's norm on words that the file
    has, so only files with enough of it are counted word by word.
    """
    weights = [{w: n * idf[w] for w, n in _template_terms(t).items()} for _, t in texts]
    norms = [math.sqrt(sum(v * v for v in t.values())) for t in weights]
    vocabulary = sorted({w for t in weights for w in t})
    rows = "\n".join(" ".join([w, repr(idf[w]), *(repr(t.get(w, 0.0)) for t in weights)]) for w in vocabulary)
    cells = files.sparkSession.range(1).select(F.explode(F.split(F.lit(rows), "\n")).alias("row")).select(F.split("row", " ").alias("c"))
    known = F.broadcast(cells.select(F.col("c")[0].alias("w"), F.col("c")[1].cast("double").alias("idf"),
                                     *(F.col("c")[k + 2].cast("double").alias(f"t{k}") for k in range(len(weights)))))
    key = ["path", "text_key"]
    keyed = files.withColumn("text_key", F.xxhash64("text"))
    seen = keyed.select(*key, F.explode(F.array_intersect(_terms(F.col("text")), _literal(vocabulary))).alias("w"))
    shares = seen.join(known, "w").groupBy(*key).agg(F.greatest(*(F.sum(F.pow(f"t{k}", F.lit(2.0))) / norm ** 2 for k, norm in enumerate(norms)), F.lit(0.0)).alias("share"))
    open_ = cut(shares.where(F.col("share") >= LIKENESS * LIKENESS - 1e-9).select(*key), "license-candidates")
    words = keyed.join(open_, key, "left_semi").select(*key, F.explode(_terms(F.col("text"))).alias("w")).groupBy(*key, "w").agg(F.count("*").alias("tf"))
    x = F.coalesce("idf", F.lit(other)) * F.col("tf")
    scored = words.join(known, "w", "left").withColumn("x", x).groupBy(*key).agg(
        F.sum(F.pow("x", F.lit(2.0))).alias("norm"), *(F.sum(F.coalesce(f"t{k}", F.lit(0.0)) * F.col("x")).alias(f"dot{k}") for k in range(len(weights))))
    best = _best([name for name, _ in texts], norms)
    return scored.withColumn("best", best).where(F.col("best.score") >= LIKENESS).select(*key, "best.license", "best.score")


def _covered(runs: Column) -> Column:
    """Words in the runs (start, stop, score); of runs that overlap, the one
    with the higher score counts, then the longer one."""
    size = lambda r: r["stop"] - r["start"]
    better = lambda r, s: (r["score"] > s["score"]) | ((r["score"] == s["score"]) & (size(r) > size(s)))
    begin = F.struct(F.lit(0).alias("n"), F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit(0.0).alias("score")).alias("last"))
    ended = F.aggregate(F.array_sort(runs), begin, lambda a, r: F.struct(
        (a["n"] + F.when(r["start"] >= a["last"]["stop"], size(a["last"])).otherwise(0)).alias("n"),
        F.when((r["start"] >= a["last"]["stop"]) | better(r, a["last"]), r).otherwise(a["last"]).alias("last")))
    return ended["n"] + size(ended["last"])


def _parents(directory: Column) -> Column:
    """The directory and all above it, with their depth; the root is the empty path."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))


def scan(files: DataFrame, templates=TEMPLATES, texts=TEXTS) -> DataFrame:
    """path, own_license, own_score, is_license_file, license, inherited_from: one row per row of ``files`` (path, text).

    Null and empty texts have no license of their own but inherit one. A null
    path is the root's. A full text goes before lines and runs; of several best
    ones or license files, the highest score wins, then the name that sorts
    last. A license file is like a full text, or has half of its words in
    matching lines or in matching runs. Other columns play no part.
    """
    files = files.select(F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    weighed = term_weights(files, templates, texts)
    matched = cut(line_matches(files, templates, weighed), "license-lines")
    key = ["path", "text_key"]
    found = matched.select(*key, F.struct(F.lit(False).alias("whole"), "score", "license").alias("own"), F.when(F.col("start") < 0, F.col("n_terms")).alias("line_terms"),
                           F.when(F.col("start") >= 0, F.struct("start", (F.col("start") + F.col("n_terms")).alias("stop"), "score")).alias("run"), "file_terms")
    if texts:
        whole = cut(whole_matches(files, texts, *weighed), "license-texts")
        found = found.unionByName(whole.select(*key, F.struct(F.lit(True).alias("whole"), "score", "license").alias("own")), allowMissingColumns=True)
    own = found.groupBy(*key).agg(F.max("own").alias("own"), F.sum("line_terms").alias("line_terms"), _covered(F.collect_set("run")).alias("run_terms"),
                                  F.max("file_terms").alias("file_terms"))
    rows = files.select("path", F.xxhash64("text").alias("text_key")).join(own, key, "left")
    rows = cut(rows.select(
        "path", F.regexp_replace("path", "/?[^/]*$", "").alias("directory"), F.col("own.license").alias("own_license"), F.col("own.score").alias("own_score"),
        F.coalesce(F.col("own.whole") | (F.greatest("line_terms", "run_terms") >= F.col("file_terms") * WHOLE), F.lit(False)).alias("is_license_file")), "license-files")
    granted = rows.where("is_license_file").groupBy(F.col("directory").alias("above")).agg(
        F.max(F.struct("own_score", "own_license")).alias("grant"))
    # Directories are resolved once each; files then join theirs on plain equality.
    nearest = rows.select("directory").distinct().select("directory", F.inline(_parents(F.col("directory")))).join(granted, "above").groupBy("directory").agg(
        F.max(F.struct("depth", "above", F.col("grant.own_license").alias("license"))).alias("near"))
    return rows.join(nearest, "directory", "left").select(
        "path", "own_license", "own_score", "is_license_file", F.coalesce("own_license", F.col("near.license")).alias("license"),
        F.when(F.col("own_license").isNull(), F.col("near.above")).alias("inherited_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text) of ``documents``, which has no paths: the source is the
    top directory, and the digits of doc_id without its last one, less trailing
    zeros, are the directories below."""
    digits = F.rtrim(F.floor(F.col("doc_id") / 10).cast("string"), F.lit("0"))
    below = F.array_join(F.filter(F.split(digits, ""), lambda c: c != ""), "/")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.when(below != "", below), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    return docs.select("doc_id", path.alias("path"), "text")
