"""A request handler over one index: a text gives a list of results, a list of texts a list of lists."""

from __future__ import annotations

import json
import shutil
import threading
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from treeline.operators import classify as c

CONFIG = "service.json"
#: What serves an exported folder.
HANDLER = """from treeline.service import Handler
from treeline.session import get_spark


class EndpointHandler(Handler):
    def __init__(self, path: str = "."):
        super().__init__(get_spark("service"), path)
"""


class Handler:
    """Loads the edition that the folder's configuration names, once, and answers requests."""

    def __init__(self, spark: SparkSession, folder: str):
        cfg = json.loads(Path(folder, CONFIG).read_text(encoding="utf-8"))
        self.spark, self.model = spark, cfg["model"]
        self.index = c.cached_index(spark, f"{folder}/nodes.parquet", cfg["version"], cfg["lang"], self.model)

    def __call__(self, data: dict) -> list:
        """``inputs`` is a text or a list of texts; ``parameters`` that requests may not set are left out."""
        inputs = data.get("inputs", "")
        many = [inputs] if isinstance(inputs, str) else list(inputs)
        out: list[list[dict]] = [[] for _ in many]
        texts = self.spark.createDataFrame(list(enumerate(many)), "query_id long, text string")
        found = c.respond(c.classify(texts, self.index, self.model, c.request_options(data.get("parameters"))))
        for r in found.orderBy("query_id", "rank").collect():
            out[r.query_id].append({k: v for k, v in r.asDict().items() if k not in ("query_id", "ed", "rank")})
        return out[0] if isinstance(inputs, str) else out


class SingleFlight:
    """Runs one call at a time, of which the latest that waits is next; those that a later one overtakes give None."""

    def __init__(self, call: Callable[..., object]):
        self.call, self.state, self.turn, self.latest = call, threading.Lock(), threading.Lock(), 0

    def __call__(self, *args: object) -> object:
        with self.state:
            self.latest += 1
            mine = self.latest
        with self.turn:
            return self.call(*args) if mine == self.latest else None


def progress(spark: SparkSession, report: Callable[[int, int], None], run: Callable[[], object], pause: float = 0.5) -> object:
    """The result of ``run``, while ``report`` gets (done, total) of the tasks of its stages."""
    group = f"progress-{uuid.uuid4()}"
    done = threading.Event()
    tracker = spark.sparkContext.statusTracker()

    def watch() -> None:
        last = None
        while not done.wait(pause):
            stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds]
            now = sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)
            if now != last and now[1]:
                report(*now)
            last = now

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    spark.sparkContext.setJobGroup(group, "reported", False)
    try:
        return run()
    finally:
        done.set()
        watcher.join()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        report(1, 1)


def export(spark: SparkSession, nodes: str, out: str, version: str, lang: str, model: str) -> None:
    """A folder that a Handler serves: one edition's nodes, the configuration, and a copy of this package."""
    n = spark.read.parquet(nodes)
    n.where((n.version == version) & (n.lang == lang)).write.mode("overwrite").parquet(f"{out}/nodes.parquet")
    Path(out, CONFIG).write_text(json.dumps({"version": version, "lang": lang, "model": model}), encoding="utf-8")
    Path(out, "handler.py").write_text(HANDLER, encoding="utf-8")
    Path(out, "requirements.txt").write_text("pyspark\npyarrow\nnumpy\n", encoding="utf-8")
    Path(out, "README.md").write_text(f"# Classification service\n\nEdition {version} {lang}, embedded by {model}. `handler.py` answers requests of the form\n`{{\"inputs\": text or list of texts, \"parameters\": {{...}}}}`; parameters are {', '.join(sorted(c.REQUEST))}.\n", encoding="utf-8")
    here = Path(__file__).resolve().parent
    shutil.copytree(here, Path(out, here.name), dirs_exist_ok=True, ignore=shutil.ignore_patterns("__pycache__", "llm"))
