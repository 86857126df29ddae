"""Like lines against edit similarity alone."""

from pyspark.sql import functions as F

from sensorloom.llm import lines

TEN = "Amber birds carry distant echoes from gardens hidden inland just"


def test_a_line_with_one_of_ten_words_replaced_goes(spark):
    words, rows = TEN.split(), [(0, TEN)]
    rows += [(i + 1, " ".join([*words[:i], f"new{chr(97 + i)}", *words[i + 1 :]])) for i in range(10)]
    assert all(lines.alike(TEN.lower(), t.lower(), lines.SIMILARITY) for _, t in rows)
    rows.append((11, "Wholly other things stand in this line of ten words"))
    got = lines.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in got.where(F.col("n_removed") == 0).collect()) == [0, 11]


def test_long_lines_without_spaces_are_compared(spark):
    long, other = "这是一条没有空格的很长的重复行它在每个文档里都出现一次", "今日は天気がとても良いので公園まで散歩に行きましょうと言った"
    rows = [(1, f"{long}\n菜单"), (2, f"{long}\n菜单"), (3, long[:-1] + "回"), (4, f"{other}\nAccept all cookies"), (5, "Accept all cookies")]
    got = lines.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
