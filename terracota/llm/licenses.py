"""Licence families of paragraphs: logistic regression over word n-grams, a calibrated unknown class, template comparison.

A paragraph is a run of lines that hold a letter or digit, so hard-wrapped texts and comment blocks are read whole. Documents without any word that
licences are written with (SOUGHT) have none. Of the others, lines and clauses (CLAUSE words of a paragraph, overlapping by half) with such a word are scored by the
regression. Neighbouring clauses that it takes for a licence make a span, with half a clause on either side, which it scores anew as a whole: the
family is the one that it puts first, or unknown where the calibrated probability of any family is below LEAST. The template comparison
only confirms: a span, or line, has the family that the regression chose if it holds one of that family's templates, i.e. SHARE of the words, within
SPREAD times the template's length, and the version that the family's name has. Lines are confirmed by short templates (statements of
one line), spans by all; a reworded span by LOOSE_SHARE of one of the longer ones. No other family is ever looked at.

A bounded sample trains the regression. Of each family: its templates, VARIANTS of each with a seventh or a third of the words left out, half
of them backwards, so that words tell without their neighbours, three beside or between lines of prose, and up to PER_CLASS different corpus lines that pass the family's test, a regular
expression that serves for nothing else. Of the unknown class: up to NEGATIVES different corpus lines, as
many lines and clauses with a sought word that pass no test, not even a looser one, and two thin variants of each template that keep a quarter of its words. Which corpus
rows are taken is decided by a hash of their words, once each. Features are all words and pairs of neighbouring words, hashed to FEATURES places; none is cut
off. A fifth of the corpus rows and one variant of
each kind are held out: on two thirds of those, a second regression maps the classifier's margin of licence over unknown to a
probability; on the last third its calibration error is measured (`calibration_error`: mean distance of probability and share, by
tenths).

Cases: null and empty texts have no paragraphs; rows that repeat are answered row by row; very long lines and texts are never cut but
into clauses; of families with equal scores the one that is listed first counts, and a document's come sorted; a corpus without any licence is trained on the templates alone; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terracota.llm.common import BROADCAST_ROWS, bounded_broadcast, keyed_join, row_key, written

PER_CLASS, NEGATIVES, VARIANTS, LEAST, SHARE, LOOSE_SHARE, CLAUSE, SPREAD, FEATURES, SHORT = 300, 3000, 4, 0.5, 0.8, 0.6, 40, 1.5, 1 << 14, 20


def _gnu(name: str, version: str) -> str:
    """Test for a GNU licence: the first version named after it, or the one named just before it."""
    return rf" gnu {name}public license (?:(?!version|v\d)\S+ ){{0,16}}(?:version |v ?){version} | version {version} of the gnu {name}public license "


_NOTICE = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}Public License as published by the Free Software Foundation, "
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."
_DEAL = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_CC, _SHARE, _NO = "This work is licensed under a Creative Commons {0} 4.0 International License.", "(?:sa|share ?alike)", r"(?:nd|no ?deriv\w*)"
_NC = "(?:by nc|attribution non ?commercial)"


def _gnu_texts(name: str, what: str, version: str, title: str) -> list[str]:
    notice = _NOTICE.format(what, name)
    return [f"This work is licensed under the GNU {name}Public License, version {version}.", f"{notice}version {version}.", f"{notice}either version {version} of the License, or (at your option) any later version.", f"GNU {name}Public License Version {version}, {title}"]


def _cc_texts(short: str, long: str) -> list[str]:
    return [f"Licensed under CC {short} 4.0.", _CC.format(short), _CC.format(long)]


#: Families: test over the words with a blank on either side, templates in the wording of the publishers' notices, titles and first
#: paragraphs or of one-line statements. Fixed values.
FAMILIES = {
    "agpl-3.0": (_gnu("affero general ", "3"), _gnu_texts("Affero General ", "program", "3", "19 November 2007")),
    "apache-2.0": (r" apache license (?:version |v )?v?2 ", ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004"]),
    "bsd": (r" redistribution and use in source and binary forms with or without modification | (?:2|3|two|three) clause bsd license | bsd [23] clause license | (?:new|modified|simplified|revised) bsd license ", ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "Released under the 2-Clause BSD License.", "Released under the new BSD License."]),
    "bsl-1.0": (r" any person or organization obtaining a copy of the software and accompanying documentation covered by this license | boost software license version 1 ", ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "Distributed under the Boost Software License, Version 1.0."]),
    "cc-by": (r" (?:cc|creative commons) (?:by|attribution) (?!nc |non|sa |share|nd |no ?deriv)", _cc_texts("BY", "Attribution")),
    "cc-by-nc": (rf" {_NC} (?!{_SHARE} |{_NO} )", _cc_texts("BY-NC", "Attribution-NonCommercial")),
    "cc-by-nc-nd": (rf" {_NC} {_NO} ", _cc_texts("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")),
    "cc-by-nc-sa": (rf" {_NC} {_SHARE} ", _cc_texts("BY-NC-SA", "Attribution-NonCommercial-ShareAlike")),
    "cc-by-nd": (rf" (?:by|attribution) {_NO} ", _cc_texts("BY-ND", "Attribution-NoDerivatives")),
    "cc-by-sa": (rf" (?:by|attribution) {_SHARE} ", _cc_texts("BY-SA", "Attribution-ShareAlike")),
    "cc0-1.0": (r" cc0 | waived all copyright and related or neighboring rights ", ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."]),
    "epl-2.0": (r" eclipse public license (?:version |v )?v?2 ", ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0."]),
    "gpl-2.0": (_gnu("general ", "2"), _gnu_texts("General ", "program", "2", "June 1991")),
    "gpl-3.0": (_gnu("general ", "3"), _gnu_texts("General ", "program", "3", "29 June 2007")),
    "isc": (r" isc license | permission to use copy modify (?:and )?(?:or )?distribute this software for any purpose with or without fee is hereby granted provided ", [f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."]),
    "0bsd": (r" permission to use copy modify (?:and )?(?:or )?distribute this software for any purpose with or without fee is hereby granted (?!provided )", [f"{_ISC}."]),
    "lgpl-2.1": (_gnu("lesser general ", "2 1"), _gnu_texts("Lesser General ", "library", "2.1", "February 1999")),
    "lgpl-3.0": (_gnu("lesser general ", "3"), _gnu_texts("Lesser General ", "library", "3", "29 June 2007")),
    "mit": (r" mit license | permission is hereby granted free of charge to any person obtaining a copy of this software (?!.* furnished to do so (?!subject ))", ["Released under the MIT License.", f"MIT License: {_GRANT}", f"{_DEAL}, subject to the following conditions:"]),
    "mit-0": (r" mit no attribution | permission is hereby granted free of charge .* furnished to do so (?!subject )", [f"{_DEAL}.", "Released under the MIT No Attribution License."]),
    "mpl-2.0": (r" mozilla public license (?:version |v )?v?2 ", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"]),
    "unlicense": (r" free and unencumbered software released into the public domain ", ["This is free and unencumbered software released into the public domain."]),
}
#: Looser tests: texts that pass one may be reworded licences, so they aren't taken as examples of the unknown class. Fixed values.
LOOSE = {
    "bsd": r" source (?:and|or) binary ",
    "bsl-1.0": r" person or organi[sz]ation .* software and accompanying documentation ",
    "cc0-1.0": r" waives? .* copyright and related or neighbou?ring rights ",
    "isc": r" (?:use )?copy modify (?:and )?(?:or )?distribute this software .*(?:provided|as long as) ",
    "mit": r" (?:sublicense|sell) .* subject to ",
    "mit-0": r" (?:sublicense|sell) (?!.* subject to )",
    "unlicense": r" unencumbered .* public domain ",
}
#: Families that may be known without their name or version, by what they grant.
REWORDED = frozenset(LOOSE)
#: A licence has one of these, or is "by" after cc or before nc, nd or sa.
SOUGHT = ("licen", "redistribut", "bsd", "permission", "permitted", "attribution", "creative", "cc0", "waive", "unencumbered")
#: Lines without a letter or digit part the paragraphs.
PARTED = r"\n[^\p{L}\p{N}]*\n"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def pairs(tokens: str) -> Column:
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def _joined() -> Column:
    return F.concat(F.lit(" "), F.concat_ws(" ", "tokens"), F.lit(" "))


def _sought(text: Column, gap: str = r"[^\p{L}\p{N}]+") -> Column:
    """True if the lower-cased text has a word that licences are written with."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in SOUGHT)) | text.rlike(f"by{gap}n[cd]|by{gap}sa|cc{gap}by")


def _paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, key, paragraph, lines, all) of docs(doc_id, key, text): the words of each paragraph's lines, and all of them."""
    lines = lambda x: F.filter(F.transform(F.split(x, "\n"), words), lambda w: F.size(w) > 0)
    blocks = docs.select("doc_id", "key", F.posexplode(F.transform(F.split("text", PARTED), lines)).alias("paragraph", "lines"))
    return blocks.where(F.size("lines") > 0).withColumn("all", F.flatten("lines"))


def _units(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, key, paragraph, place, tokens) with a sought word: lines (place -1, where a paragraph has several) and clauses (place from 1)."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - CLAUSE // 2), F.lit(CLAUSE // 2))
    clauses = F.transform(starts, lambda i: F.struct(i.alias("place"), F.slice("all", i, F.lit(CLAUSE)).alias("tokens")))
    lines = F.when(F.size("lines") > 1, F.transform("lines", lambda w: F.struct(F.lit(-1).alias("place"), w.alias("tokens")))).otherwise(F.slice(clauses, 1, 0))
    one = F.when(F.size("lines") == 1, F.array(F.struct(F.lit(-1).alias("place"), F.get("lines", F.lit(0)).alias("tokens")))).otherwise(lines)
    return paragraphs.select("doc_id", "key", "paragraph", F.explode(F.concat(one, clauses)).alias("u")).select("doc_id", "key", "paragraph", "u.*").where(_sought(F.concat_ws(" ", "tokens"), " "))


def _label() -> Column:
    return F.coalesce(*(F.when(_joined().rlike(test), i) for i, (test, _) in enumerate(FAMILIES.values(), 1)), F.lit(0))


def _some(rows: DataFrame, most: int) -> DataFrame:
    """Up to most different rows(tokens, label) of each label, those with the least hashes. A share that leaves about twice as many is taken first, so no label's rows all meet in a task."""
    rows = rows.select("tokens", "label", F.xxhash64("tokens").alias("h"))
    sizes = rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n"))  # a row a family
    near = rows.join(F.broadcast(sizes), "label").where(F.pmod("h", F.lit(1_000_000)) < 1_000_000 * F.least(F.lit(1.0), 2 * most / F.col("n"))).dropDuplicates(["label", "h"])
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("h", F.lit(1_000_000)), "h"))
    return near.withColumn("place", place).where(F.col("place") <= most).select("tokens", "label", (F.pmod(F.xxhash64("h"), F.lit(5)) == 0).alias("held"), F.lit(False).alias("made"))


def _variants(given: DataFrame) -> DataFrame:
    """Templates(tokens, label) whole, with words left out, and thin ones of the unknown class."""
    seeds = F.explode(F.sequence(F.lit(0), F.lit(VARIANTS + 2))).alias("seed")
    spread = given.select("tokens", "label", seeds)
    keep = F.when(F.col("seed") == 0, 100).when(F.col("seed") <= VARIANTS // 2, 86).when(F.col("seed") <= VARIANTS, 70).otherwise(25)
    thin = F.filter("tokens", lambda t, i: F.pmod(F.xxhash64(t, i, F.col("seed")), F.lit(100)) < keep)
    thin = F.when(F.col("seed") % 2 == 1, thin).otherwise(F.when(F.col("seed") == 0, thin).otherwise(F.reverse(thin)))  # backwards, no pair is left
    return spread.select(thin.alias("tokens"), F.when(F.col("seed") <= VARIANTS, F.col("label")).otherwise(0).alias("label"), F.col("seed").isin(VARIANTS, VARIANTS + 2).alias("held"), F.lit(True).alias("made")).where(F.size("tokens") > 0)


def _sample(docs: DataFrame, units: DataFrame) -> DataFrame:
    """(tokens, label, held, made) of the bounded training sample, from docs(key, text) and the units of all candidates."""
    known = written(units.select("tokens", "place").withColumn("label", _label()), "labelled-units")
    other = (F.col("label") == 0) & ~_joined().rlike("|".join(LOOSE.values()))  # what may be a reworded licence teaches neither
    share = NEGATIVES / max(1, docs.count())
    hashed = F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share * 1_000_000
    # words are cut inside the generator, so that filters above it don't cut them again
    lines = docs.where(hashed).select(F.explode(F.transform(F.split("text", "\n"), words)).alias("tokens")).where(F.size("tokens") > 0).withColumn("label", _label()).where(other)
    given = docs.sparkSession.createDataFrame([(t, i) for i, (_, ts) in enumerate(FAMILIES.values(), 1) for t in ts], "text string, label int").select(words(F.col("text")).alias("tokens"), "label")
    prose = written(_some(lines, NEGATIVES), "license-prose")
    # templates between lines of prose, as a span may have them
    numbered = lambda df, by: df.withColumn("i", F.row_number().over(Window.orderBy(by)))  # noqa: E731  bounded rows
    around = numbered(prose.select(F.slice("tokens", 1, CLAUSE // 2).alias("p"), F.xxhash64("tokens").alias("h")), "h").select("i", "p")
    padded = numbered(given.withColumn("id", F.explode(F.array(*map(F.lit, range(3))))), F.xxhash64("tokens", "id")).join(around, "i").select(F.when(F.col("id") == 0, F.concat("p", "tokens")).when(F.col("id") == 1, F.concat("tokens", "p")).otherwise(F.concat("p", "tokens", "p")).alias("tokens"), "label", F.lit(False).alias("held"), F.lit(True).alias("made"))
    return _some(known.where("label > 0 and place = -1"), PER_CLASS).unionByName(_some(known.where(other), NEGATIVES)).unionByName(prose).unionByName(_variants(given)).unionByName(padded)


class Classifier:
    """Trained on a sample; predictions are columns of Spark's own transformers."""

    def __init__(self, sample: DataFrame):
        sample = written(sample.coalesce(1), "license-sample").coalesce(1)  # bounded rows: one task for each step of the fit
        train, held = sample.where(~F.col("held")), sample.where("held")
        self.terms = HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES, binary=True)
        # licence rows and others weigh the same in all, however many of either there are
        sizes = train.agg(F.count_if(F.col("label") > 0).alias("some"), F.count_if(F.col("label") == 0).alias("none")).first()
        train = train.withColumn("weight", F.when(F.col("label") > 0, F.lit(sizes["none"] / max(1, sizes["some"]))).otherwise(1.0))
        self.model = LogisticRegression(maxIter=60, regParam=0.002, labelCol="label", weightCol="weight", featuresCol="features", probabilityCol="p", rawPredictionCol="raw", predictionCol="best", family="multinomial").fit(self.terms.transform(self._terms(train)))
        self._calibrate(written(self._margins(held).select("margin", (F.col("label") > 0).cast("double").alias("y"), F.xxhash64("tokens").alias("h")).coalesce(1), "license-held"))

    def _calibrate(self, held: DataFrame) -> None:
        fit = VectorAssembler(inputCols=["margin"], outputCol="x").transform(held.where(F.pmod("h", F.lit(3)) > 0))
        scale = LogisticRegression(maxIter=60, regParam=0.001, labelCol="y", featuresCol="x").fit(fit)
        self.slope, self.offset = float(scale.coefficients[0]), float(scale.intercept)
        test = held.where(F.pmod("h", F.lit(3)) == 0).withColumn("p", self._probability())
        tenths = test.groupBy(F.floor(F.col("p") * 9.999)).agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("off"))
        self.calibration_error = tenths.agg(F.sum(F.col("n") * F.col("off")) / F.sum("n")).first()[0] or 0.0

    def _probability(self) -> Column:
        return 1 / (1 + F.exp(-(self.slope * F.col("margin") + self.offset)))

    def _terms(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("terms", F.concat("tokens", pairs("tokens")))

    def _margins(self, rows: DataFrame) -> DataFrame:
        """rows with the log odds of any family over none, and the family that comes first."""
        out = self.model.transform(self.terms.transform(self._terms(rows))).withColumn("ps", vector_to_array("p"))
        own = F.slice("ps", F.lit(2), F.lit(len(FAMILIES)))
        first = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position(own, F.array_max(own)).cast("int"))
        none = F.greatest(F.get("ps", F.lit(0)), F.lit(1e-9))
        return out.withColumn("margin", F.log(F.greatest(1 - none, F.lit(1e-9)) / none)).withColumn("first", first).drop("terms", "features", "raw", "p", "ps", "best")

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows(tokens) with the calibrated probability that they have any family, and the likeliest one (first)."""
        return self._margins(rows).withColumn("probability", self._probability()).drop("margin")


def _holds(family: str, template: str, share: float) -> Column:
    """True if enough of the template's words, and the version in the family's name, stand close together in tokens."""
    t = re.findall(r"[^\W_]+", template.lower())
    least, width = math.ceil(share * len(set(t))), math.ceil(SPREAD * len(t))
    version = [v for v in re.findall(r"\d+", family.partition("-")[2]) if v != "0" and v in t]
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("tokens") - width + 1))
    own = lambda ws: F.array(*map(F.lit, sorted(set(ws))))

    def inside(i: Column) -> Column:
        found = F.array_intersect(F.slice("tokens", i, F.lit(width)), own(t))
        return (F.size(found) >= least) & (F.size(F.array_intersect(found, own(version))) == len(set(version)) if version else F.lit(True))

    return (F.size(F.array_intersect("tokens", own(t))) >= least) & F.exists(starts, inside)


def confirmed() -> Column:
    """True if a template of the family that the classifier put first confirms it; whole: the row is a span, and not a line."""
    any_of = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    of = lambda k, ts: any_of(_holds(k, t, SHARE) & (F.lit(len(t.split()) <= SHORT) | F.col("whole")) for t in ts) | (F.col("whole") & any_of(_holds(k, t, LOOSE_SHARE) for t in ts if len(t.split()) > SHORT / 2 and k in REWORDED))
    return F.coalesce(*(F.when(F.col("first") == k, of(k, ts)) for k, (_, ts) in FAMILIES.items()), F.lit(False))


def spans(scored: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, key, paragraph, tokens) of the runs of neighbouring clauses in scored(key, paragraph, place, ...) that are licences, with half a clause on either side."""
    order = Window.partitionBy("key", "paragraph").orderBy("place")  # the clauses of one paragraph
    places = scored.where("place > 0").select("key", "paragraph", "place").distinct()
    runs = places.withColumn("gap", F.col("place") - F.lag("place", 1, -CLAUSE * 2).over(order)).withColumn("run", F.sum((F.col("gap") > CLAUSE // 2).cast("int")).over(order))
    ends = runs.groupBy("key", "paragraph", "run").agg(F.min("place").alias("from"), F.max("place").alias("to"))
    begin = F.greatest(F.lit(1), F.col("from") - CLAUSE // 2)
    found = paragraphs.select("doc_id", "key", "paragraph", "all").join(bounded_broadcast(written(ends, "license-runs")), ["key", "paragraph"])
    return found.select("doc_id", "key", "paragraph", F.slice("all", begin, F.col("to") + CLAUSE + CLAUSE // 2 - begin).alias("tokens"))


def license_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classifier: Classifier | None = None) -> DataFrame:
    """(doc_id, key, paragraph, family, probability) of the lines and spans with a confirmed licence; key tells rows with equal ids apart. classifier: trained on docs unless given."""
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    candidates = rows.where(F.exists(F.array(F.lower("text")), lambda x: _sought(x)))
    paragraphs = _paragraphs(candidates)
    units = written(_units(paragraphs), "license-units")
    classifier = classifier or Classifier(_sample(rows, units))
    scored = written(classifier.scored(units).where(F.col("probability") >= LEAST), "license-scores")
    whole = classifier.scored(written(spans(scored, paragraphs), "license-spans")).where(F.col("probability") >= LEAST)
    columns = ["doc_id", "key", "paragraph", "tokens", "first", "probability", "whole"]
    found = whole.withColumn("whole", F.lit(True)).select(columns).unionByName(scored.where("place = -1").withColumn("whole", F.lit(False)).select(columns))
    return found.where(confirmed()).select("doc_id", "key", "paragraph", F.col("first").alias("family"), "probability")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, n_license, families, probability) for each row of docs; families are sorted and comma-joined."""
    found = license_paragraphs(docs, id_col, text_col).groupBy("key").agg(F.count_distinct("paragraph").alias("n_license"), F.concat_ws(",", F.array_sort(F.collect_set("family"))).alias("families"), F.round(F.max("probability"), 6).alias("probability"))
    found = written(found, "licenses")
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.size(F.filter(F.split(F.coalesce(text_col, F.lit("")), PARTED), lambda x: x.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("n_paragraphs"))
    if found.count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(found), "key", "left")
    else:
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
        out = keyed_join(rows, written(found.join(sizes, "key"), "sized-licenses"), "key", docs.count(), "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_license", F.lit(0)).alias("n_license"), F.coalesce("families", F.lit("")).alias("families"), "probability")
