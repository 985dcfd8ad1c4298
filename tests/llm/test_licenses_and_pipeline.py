from __future__ import annotations

import hashlib
import re
import textwrap
from pathlib import Path

import corpus_pipeline
import pytest
from catalog.check import connect, differences
from pyspark.sql import functions as F
from stepwell.llm import licenses, mixing
from stepwell.llm.queries import MIX_SIZE, TARGETS, llm_oracles, llm_queries
from stepwell.plans.scratch import materialize

from .conftest import ODD

SF = "/root/testdata/sf0.001"
MIT = next(body for n, _, body in licenses.LICENSES if n == "MIT")
PUBLISHED = Path("/usr/share/common-licenses")


def test_whole_texts_and_lines(spark, docs, monkeypatch):
    texts = [
        "Copyright (c) 2020 Somebody\n\n" + MIT.upper().replace("COPYRIGHT HOLDERS", "copyright owners"),
        "prose\n  LICENSED under the Apache Licence, version 2.0!\nmore\nReleased under the MIT License.",
        "Released under the MIT License. And more on the line",
        "(C) all rights reserved\n",
    ]
    for bound in (licenses.MAX_BROADCAST, -1):
        monkeypatch.setattr(licenses, "MAX_BROADCAST", bound)
        rows = licenses.scan(docs(*texts), licenses.known_licenses(spark)).orderBy("doc_id").collect()
        assert [r.license for r in rows] == ["MIT", None, None, None]
        assert [r.notices for r in rows] == [None, "Apache-2.0,MIT", None, None]
        assert rows[3].digest is None
    odd = licenses.scan(docs(*ODD), licenses.known_licenses(spark)).collect()
    assert len(odd) == len(ODD)
    one = next(r for r in odd if r.doc_id == 1)
    assert one.digest == hashlib.sha256(ODD[0][1].encode()).hexdigest()
    assert licenses.scan(docs(*ODD).limit(0), licenses.known_licenses(spark)).count() == 0


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


def test_published_files_in_any_line_wrap(spark, docs):
    names, texts = [], []
    statements = [
        "Copyright (c) 2024 Somebody", "Copyright \u00a9 2019-2024, The Authors. All rights reserved.",
        "Copyright (c) <year> <holder>\nCopyright 2001 by Another\nAll rights reserved.", "(c) 2020 Us", "",
        "Copyright [yyyy] [name]", "  * Copyright by the authors",
    ]
    for name, titles, body in licenses.LICENSES:
        for at, title in enumerate(["", *titles]):
            for width in (30, 47, 72, 10_000):
                names.append(name)
                texts.append(f"{title}\n\n{statements[(at + width) % len(statements)]}\n\n{wrapped(body, width)}\n")
    before_notice = re.sub(r" (copyright (?:notice|holders))", r"\n\1", MIT, flags=re.I)
    assert before_notice.count("\n") > MIT.count("\n")
    rows = licenses.scan(docs(*texts, before_notice), licenses.known_licenses(spark)).orderBy("doc_id").collect()
    assert [r.license for r in rows] == [*names, "MIT"]


def test_texts_that_differ_in_a_word_are_no_licence(spark, docs):
    texts = [MIT.replace("hereby ", ""), MIT + " And more.", MIT.replace("copyright notice", "notice"), MIT[:-40]]
    assert {r.license for r in licenses.scan(docs(*texts), licenses.known_licenses(spark)).collect()} == {None}
    kept = docs("Copyright notice of the house", "copyright law is old", "Copyright 2020 Us\nprose").select(
        licenses.one_line(licenses.canonical_lines(F.col("text")))
    )
    assert [r[0] for r in kept.collect()] == ["copyright notice of the house", "copyright law is old", "prose"]


@pytest.mark.skipif(not PUBLISHED.is_dir(), reason="no published licence files on this machine")
def test_long_licences_by_digest(spark, docs):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    texts, names = [], []
    for file, name in files.items():
        text = (PUBLISHED / file).read_text()
        texts += [text, text.upper(), text.split("END OF TERMS AND CONDITIONS")[0], text.replace("\n\n", "\n \n\n")]
        names += [name] * 4
    rows = licenses.scan(docs(*texts), licenses.known_licenses(spark)).orderBy("doc_id").collect()
    assert [r.license for r in rows] == names


@pytest.mark.parametrize("name", llm_oracles())
def test_query_equals_its_sql(spark, name):
    assert differences(spark, connect(SF), SF, llm_queries()[name], llm_oracles()[name]) == []


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        now = {r.doc_id for r in rows}
        assert len(rows) == len(now) and now <= seen
        docs, seen = spark.createDataFrame(rows, docs.schema), now
    last = corpus_pipeline.tokenize(spark, docs, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in last} == {
        i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()
    }
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, last))


def test_the_mix_stage_of_the_pipeline_leaves_a_corpus(spark):
    sf = "/root/testdata/sf0.01"
    docs = materialize(corpus_pipeline.keep_good(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf))
    docs = materialize(corpus_pipeline.drop_near_duplicates(spark, docs, sf))
    rows = mixing.sampled(docs, TARGETS, MIX_SIZE)
    total, kept = rows.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).head()
    assert kept >= 0.09 * total
