"""Index building in steps that are skipped where their output exists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.markup import articles, plain_text
from lexloom.functions.normalize import corpus_text
from lexloom.operators import index
from lexloom.operators.search import beginning, find
from lexloom.sources.corpus import TITLE_WEIGHT, wiki_pages
from lexloom.sources.staging import staged_sorted

STEPS = ("extract", "index", "merge", "test")


@dataclass
class Build:
    """dumps: names and XML paths; all of them go into one merged index under `root`."""

    root: str
    dumps: dict[str, str]
    steps: tuple[str, ...] = STEPS
    cutoff: int = 5
    test: str = "the_*"
    dry_run: bool = False
    log: list[str] = field(default_factory=list)

    def exists(self, spark: SparkSession, path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def step(self, spark: SparkSession, name: str, path: str, make) -> None:
        if self.exists(spark, path):
            self.log.append(f"{name}: {path} exists")
        elif self.dry_run:
            self.log.append(f"{name}: would write {path}")
        else:
            self.log.append(f"{name}: {path}")
            make()

    def run(self, spark: SparkSession) -> DataFrame | None:
        for name, source in self.dumps.items():
            text, part = f"{self.root}/text/{name}", f"{self.root}/parts/{name}"
            if "extract" in self.steps:
                self.step(spark, "extract", text, lambda s=source, t=text: plain_text(articles(wiki_pages(spark, s)), "text").select("title", "plain").write.parquet(t))
            if "index" in self.steps:
                self.step(spark, "index", f"{part}/chains", lambda t=text, p=part: index.save(self.counts(spark, t), p, in_order=True))
        whole = f"{self.root}/index"
        if "merge" in self.steps:
            parts = [f"{self.root}/parts/{n}" for n in self.dumps]
            self.step(spark, "merge", f"{whole}/chains", lambda: index.save(index.merge_rounds(spark, parts, final=self.cutoff, stage=staged_sorted), whole, in_order=self.cutoff <= 1))
        if "test" in self.steps and not self.dry_run:
            return find(index.boundary_phrases(beginning(index.load(spark, whole), self.test)), self.test, limit=100)
        return None

    def counts(self, spark: SparkSession, path: str) -> DataFrame:
        pages = spark.read.parquet(path)
        titles = pages.select(F.col("title").alias("text"), F.lit(TITLE_WEIGHT).alias("weight"))
        lines = pages.select(F.explode(F.split("plain", "\n")).alias("text"), F.lit(1).alias("weight"))
        return index.chain_counts(corpus_text(titles.unionAll(lines)), "normalized", "weight")


def merge_plan(n: int, fan_in: int = 200) -> list[list[int]]:
    """Batch sizes of each merge round, the final one last."""
    rounds = []
    while n > fan_in:
        batches = [min(fan_in, n - i) for i in range(0, n, fan_in)]
        rounds.append(batches)
        n = len(batches)
    return [*rounds, [n]]
