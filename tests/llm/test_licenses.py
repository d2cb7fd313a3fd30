import math
import re

import pytest

from palio.llm import licenses

SCHEMA = "doc_id long, text string"


def labels(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r["doc_id"]: (set(r["labels"].split(",")), r["score"]) for r in licenses.scan(frame).collect()}


def test_every_notice_of_a_file_is_found(spark):
    texts = [
        "All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted",
        "This is free and unencumbered software released into the public domain. Licensed under CC BY 4.0",
        " filler words. ".join(n for _, n, _ in licenses.NOTICES),
    ]
    got = labels(spark, texts)
    assert got[0][0] == {"bsd", "proprietary"}
    assert got[1][0] == {"unlicense", "cc-by-4.0"}
    assert got[2][0] >= {label for label, _, _ in licenses.NOTICES}


@pytest.mark.parametrize("cut", ["\n", "  ", "\n * ", "_"])
def test_notices_with_any_separators_between_words(spark, cut):
    got = labels(spark, [n.replace(" ", cut).upper() for _, n, _ in licenses.NOTICES])
    for i, (label, notice, _) in enumerate(licenses.NOTICES):
        assert label in got[i][0] and got[i][1] > 0.99, notice
        assert re.search(licenses._HINT, notice.replace(" ", cut))


def test_weights_count_files_without_a_hint(spark):
    texts = ["cc by 4 0", "Licensed under CC BY 4.0", *("filed under nothing, licensed to no one" for _ in range(40))]
    assert not any(re.search(licenses._HINT, t) for t in texts[2:])
    held = {w: sum(w in re.findall("[a-z0-9]+", t.lower()) for t in texts) for w in ("licensed", "under", "cc", "by", "4", "0")}
    weight = {w: math.log((len(texts) + 1) / n) + 0.01 for w, n in held.items()}
    got = labels(spark, texts)
    assert got[0] == ({"cc-by-4.0"}, pytest.approx(1 - (weight["licensed"] + weight["under"]) / sum(weight.values())))
    assert got[1] == ({"cc-by-4.0"}, pytest.approx(1.0))
    assert got[2] == ({""}, 0.0)
