"""Spelt and spaced addresses are redacted by a model fitted on texts that hold only strict ones; prose with `(at)` is not."""

import random

from harvestry.llm import pii


def test_spelt_addresses_are_redacted(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))
    texts = []
    for i in range(300):
        parts = [" ".join(word() for _ in range(r.randint(4, 9))).capitalize() + "." for _ in range(5)]
        if i % 2:
            parts.insert(2, f"Write to {word()}.{word()}@{word()}.{r.choice(['com', 'org', 'net', 'de'])} today.")
        texts.append(" ".join(parts))
    spelt = ["john [at] example [dot] com", "mary.poe (at) mail (dot) example (dot) org", "john @ example.com"]
    texts += [f"Contact {s} now" for s in spelt]
    prose = ["We sat (at) lunch. Then nothing", "they met @ noon. Nobody came"]
    texts += prose
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert "email" in pii.fit(docs)
    got = {x.doc_id: x.redacted for x in pii.redact(pii.find(docs)).collect()}
    for i, s in enumerate(spelt, 300):
        assert got[i] == f"Contact {'*' * len(s)} now"
    assert [got[i] for i in (303, 304)] == prose
