"""What a task's Python holds at once, whatever the length of texts."""

import pyarrow as pa
from pyspark.sql import functions as F

from harvestry.llm import common, packing
from harvestry.llm.queries import tokenizer_path


def test_batches_are_bounded_by_bytes(spark):
    """10,000 texts of 4,000 signs came as one batch of 40 MB."""

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 10_000, 1, 1).select(F.repeat(F.lit("x"), 4_000).alias("text"))
    out = common.materialise(texts.mapInArrow(size, "rows long, bytes long"), "sizes")
    found = [tuple(r) for r in out.collect()]
    common.drop_table(out)
    assert sum(n for n, _ in found) == 10_000 and max(b for _, b in found) < 5 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_remembered_words_are_bounded():
    """Two calls of 200,000 words each: the memory is emptied between them, and ids stay those of the library."""
    encode = packing.WordTokenizer(tokenizer_path())
    texts = [" ".join(f"w{i}" for i in range(lo, lo + 200_000)) for lo in (0, 200_000)]
    got = [encode([t])[0] for t in texts]
    assert encode.known <= 300_000
    assert all((a == encode.whole(t)).all() for a, t in zip(got, texts))
