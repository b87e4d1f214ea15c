"""Small tables are written in few files; words of items are letters of the automaton."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.llm.common import cut
from tessella.llm.decontaminate import Scanner


def test_small_tables_have_few_files_and_all_rows(spark):
    made = cut(spark.range(5000).repartition(64).withColumn("k", F.col("id") % 7), "made")
    assert len(made.inputFiles()) == 64
    for like in (made, spark.range(10), spark.createDataFrame(made.rdd)):
        done = cut(made.repartition(64, "id"), "like", like)
        assert sorted(r.id for r in done.collect()) == list(range(5000))
    assert len(cut(made, "few", made).inputFiles()) <= 4
    assert len(cut(made.where("id < 0"), "none", made).collect()) == 0


def test_words_of_many_items_keep_their_letters():
    items = [(f"i{k}", b" ".join(b"w%d" % (k * 3 + j) for j in range(12))) for k in range(400)]
    scanner = Scanner(items, 10)
    assert len(set(scanner.letters.values())) == len(scanner.letters) == 399 * 3 + 12
    for k in (0, 7, 399):
        text = b"other words, " + items[k][1].upper() + b" w1 W5 \0 end"
        words = text.translate(scanner.table).split()
        near = {f"i{m}" for m in range(400) for s in range(3) for t in range(len(words) - 9) if items[m][1].split()[s : s + 10] == words[t : t + 10]}
        n, ranges, names = scanner.scan(text)
        assert n == len(words) and ranges == [(2, 14)] and names == near and f"i{k}" in near
