"""Every training-data query that SQL can express against its oracle, on the smallest tables and on rows made to be awkward."""

import duckdb
import pytest

from quern.llm.oracles import ORACLES
from quern.llm.queries import queries

SF = "/root/testdata/sf0.001"


def awkward(spark, folder):
    line = " ".join(f"p{i}" for i in range(16))
    long = " ".join(f"v{(i * i) % 211}é" for i in range(4000))
    texts = [None, "", " \n\t ", "one", line, line, "x " + line + " y", line.upper(), "a a a " * 40, "l\nl\nl\nm # $ %", "漢字 " * 60, long, long + " end", "Ünï cödé\x0bmix \U0001f600 a-b_c", "# " * 70, "é" * 450, "é" * 200 + "z", "start " + line * 9, line * 9 + "!"]
    docs = [(i, t, "en" if i % 3 else None, f"s{i % 2}", 0) for i, t in enumerate(texts + texts[3:8])]
    items = [(1, line), (2, "P3 p4"), (3, None), (4, "..."), (5, long[4000:4600]), (6, "zebra nowhere"), (None, "one"), (7, "p9 p2 p1 p0")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    talk = [(1, 0, "ann", "hi"), (1, 1, None, None), (1, None, "system", "<|x"), (2, 0, "bob", "yo\n"), (2, 65, "ann", "z"), (2, 65, "ann", "z")]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("kind", ["given", "awkward"])
@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op1_chat_rotation"}))
def test_query_equals_its_sql(spark, tmp_path, name, kind):
    folder = SF if kind == "given" else awkward(spark, tmp_path)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if kind == 'given' else '/*.parquet'}')")
    df = queries()[name](spark, folder)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want
