import re
import time

from leafpress.llm import suffixes


def shuffles(spark):
    """Ids of the shuffles that have files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return {int(k) for k in re.findall(r"shuffle_(\d+)_\d+_\d+\.data", files)}


def test_pairs_are_gone_before_snippets(spark, sf, monkeypatch):
    """The shuffle files of the anchors' pairs don't lie on disk beside those of the snippets."""
    before, left, table = max(shuffles(spark), default=-1), [], suffixes.Scratch.table

    def watched(self, df, name):
        if name == "runs":
            until = time.time() + 10
            while (now := {k for k in shuffles(spark) if k > before}) and time.time() < until:
                time.sleep(0.1)
            left.append(now)
        return table(self, df, name)

    monkeypatch.setattr(suffixes.Scratch, "table", watched)
    assert suffixes.op3_suffix_dedup(spark, sf).count() > 0
    assert left == [set()]
