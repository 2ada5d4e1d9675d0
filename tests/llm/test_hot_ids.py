import collections

from pyspark.sql import functions as F

from rollmark.llm import mixing
from rollmark.llm.mixing import mix, mix_sizes

KINDS = "doc_id long, text string, source string"


def _rows():
    rows = [(None, "n " * (1 + i % 7), "a") for i in range(600)] + [(5, "same", "b")] * 300
    return rows + [(10 + i, f"t{i} " * (1 + i % 11), "ab"[i % 2]) for i in range(600)] + [(None, "", "a"), (None, None, None)]


def test_rows_of_one_id_are_no_group(spark, monkeypatch):
    written, table = [], mixing.Scratch.table

    def kept(self, df, name):
        written.append(table(self, df, name))
        return written[-1]

    monkeypatch.setattr(mixing.Scratch, "table", kept)
    rows = mix(spark.createDataFrame(_rows(), KINDS).repartition(4)).collect()
    longest = [df.agg(F.max(F.size(c))).first()[0] for df in written for c, kind in df.dtypes if kind.startswith("array")]
    assert all(n <= mixing.PASSES for n in longest)
    due = collections.Counter()
    for r in mix_sizes(spark.createDataFrame(_rows(), KINDS)).collect():
        due[r.doc_id, r["size"]] += len(r.positions) if r["size"] else 1
    assert collections.Counter((r.doc_id, len((r.text or "").split())) for r in rows) == +due


def test_cells_of_hot_ids_change_nothing(spark):
    df = spark.createDataFrame(_rows(), KINDS).repartition(4)
    assert sorted(mix_sizes(df, rows_per_cell=50).collect(), key=str) == sorted(mix_sizes(df).collect(), key=str)
    assert collections.Counter(mix(df, rows_per_cell=50).collect()) == collections.Counter(mix(df).collect())
