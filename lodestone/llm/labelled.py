"""A bounded sample of labelled texts, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from .shared import tidy


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, training: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(text, y)`` of at most ``max_rows`` rows of ``labels`` for which ``training`` holds, in hash order of their id.

    Half of the bound goes to each class, so that a rare class is not lost. Labels other than 0 and 1
    and labels of unknown documents are left out. Only the ids and labels of the sample are broadcast:
    ``max_rows`` rows of 12 bytes.
    """
    known = labels.where(training & F.col(label).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null")
    half = max(1, max_rows // 2)
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(half)
        picked = part if picked is None else picked.union(part)
    docs = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return docs.join(F.broadcast(picked), "_id").select("text", "y")


def train_in_one_task(sample: DataFrame, fit, max_bytes: int) -> bytes | None:
    """Run ``fit(texts: list[bytes], labels: list[int]) -> bytes`` on the (bounded) sample in one executor task.

    Returns the fitted model, None if there are no rows. Rows are put in an order that depends on
    their content only, so that runs agree; of them, as many as ``max_bytes`` of text allow are held and used.
    """

    def run(batches):
        import xxhash

        rows = []
        for b in batches:
            texts, ys = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows += [(xxhash.xxh3_64_intdigest(t or ""), (t or "").encode(), y) for t, y in zip(texts, ys, strict=True)]
            rows.sort()
            # what falls out now would fall out at the end too
            held = 0
            for k, row in enumerate(rows):
                held += len(row[1])
                if k and held > max_bytes:
                    del rows[k:]
                    break
        if rows:
            import pyarrow as pa

            yield pa.RecordBatch.from_pydict({"model": pa.array([fit([r[1] for r in rows], [r[2] for r in rows])], pa.binary())})

    got = sample.repartition(1).mapInArrow(tidy(run), "model binary").collect()
    return bytes(got[0]["model"]) if got else None
