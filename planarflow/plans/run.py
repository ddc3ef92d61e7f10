"""A census run: plan, stages, flags, reports; each part is skipped if a finished one lies under the output folder."""

from __future__ import annotations

import json
import resource
import subprocess
import sys
import time
from collections.abc import Callable
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarflow.operators import census, flags
from planarflow.plans.golden import verdicts
from planarflow.plans.graph import Census


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


class Folder:
    """Small files of a run in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        where = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self._conf)

    def has(self, name: str) -> bool:
        where, fs = self._at(name)
        return fs.exists(where)

    def write(self, name: str, text: str) -> None:
        """Written beside and renamed, so a reader sees all of it or nothing."""
        target, fs = self._at(name)
        beside, _ = self._at(f"{name}.{time.time_ns()}.tmp")
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE
        # Replaces the target in one step, so that a crash leaves the old file or the new one.
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), self._conf).rename(beside, target, how)

    def append(self, name: str, row: dict) -> None:
        """One line of JSON more, in a file of lines."""
        held = self.read(name) if self.has(name) else ""
        self.write(name, held + json.dumps(row, sort_keys=True) + "\n")

    def read(self, name: str) -> str:
        where, fs = self._at(name)
        stream = fs.open(where)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        where, fs = self._at(name)
        fs.delete(where, True)


def plan_record(c: Census) -> dict:
    """The static plan as JSON: graph, base cycle, stages, sizes of the symmetry groups."""
    return {
        "m": c.m,
        "n": c.n,
        "vertices": list(c.points.vertices),
        "edges": [list(e) for e in c.points.edges],
        "colors": list(c.colors),
        "base_cycle": list(c.cycle),
        "stages": [asdict(s) | {"symmetries": len(c.stage_group(i))} for i, s in enumerate(c.stages)],
        "automorphisms": len(c.group),
    }


def usage() -> dict[str, float]:
    """CPU seconds and peak memory (KiB) of the driver's Python so far."""
    used = resource.getrusage(resource.RUSAGE_SELF)
    return {"cpu_seconds": used.ru_utime + used.ru_stime, "max_rss_kib": used.ru_maxrss // (1024 if sys.platform == "darwin" else 1)}


def time_report(text: str) -> dict[str, str]:
    """The "key: value" lines that GNU time writes; the last colon followed by a space parts them."""
    pairs = (line.strip().rpartition(": ") for line in text.splitlines())
    return {k: v.strip() for k, _, v in pairs if k}


def git_revision(folder: str = ".") -> str:
    """The commit that is checked out in folder, or "unknown"."""
    try:
        got = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=20)
    except (OSError, subprocess.TimeoutExpired):
        return "unknown"
    return got.stdout.strip() or "unknown"


class Run:
    """The parts of a run and their record in run.json."""

    def __init__(self, spark: SparkSession, output: str, m: int, n: int, revision: str = "unknown"):
        if not 2 <= m <= n or m + n > 8:
            raise ValueError("a census needs 2 <= m <= n and m + n <= 8")
        self.spark, self.m, self.n = spark, m, n
        self.census, self.folder = census.census_of(m, n), Folder(spark, output)
        plan = json.loads(json.dumps(plan_record(self.census)))
        if self.folder.has("run.json"):
            self.record = json.loads(self.folder.read("run.json"))
            if self.record["plan"] != plan:
                raise ValueError("the folder holds a run with another plan")
        else:
            self.record = {"plan": plan, "revision": revision, "created": utc_now(), "parts": {}}
            self._save()

    def _save(self) -> None:
        self.folder.write("run.json", json.dumps(self.record, indent=1, sort_keys=True))

    def part(self, name: str, make: Callable[[], dict]) -> dict:
        """The result of a part: kept from before, or made now; failures are recorded and raised."""
        done = self.record["parts"].get(name, {})
        if done.get("status") == "done":
            return done["result"]
        began, before = time.time(), usage()
        try:
            result = make()
        except Exception as error:
            self.record["parts"][name] = {"status": "failed", "error": repr(error)[:500], "seconds": time.time() - began, "ended": utc_now()}
            self._save()
            raise
        after = usage()
        spent = {"cpu_seconds": after["cpu_seconds"] - before["cpu_seconds"], "max_rss_kib": after["max_rss_kib"]}
        self.record["parts"][name] = {"status": "done", "result": result, "seconds": time.time() - began, "driver": spent, "ended": utc_now()}
        self._save()
        return result

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.path}/{name}")

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder.path}/{name}")
        return self.table(name)

    def classes(self) -> dict:
        def make() -> dict:
            found = census.classes(self.spark, self.m, self.n, f"{self.folder.path}/classes")
            self._write("sets", census.crossing_sets(found, self.m, self.n))
            return census.strong_classes(self.table("sets"), self.m, self.n).first().asDict()

        return self.part("classes", make)

    def export(self) -> dict:
        """Labeled flags by kind, with the bucket of each; rows count orientations."""

        def make() -> dict:
            rows = flags.exported(self.table("sets"), self.census)
            rows = self._write("exported", rows.withColumn("bucket", flags.flag_bucket(F.col("flag"), False)))
            rows.select(F.concat_ws("\t", "bucket", "flag").alias("value"), "kind").write.mode("overwrite").partitionBy("kind").option("compression", "gzip").text(f"{self.folder.path}/exported-text")
            return {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}

        return self.part("export", make)

    def flag_classes(self, kind: str) -> dict:
        def make() -> dict:
            rows = flags.labeled(self.table("exported"))
            kept = self._write(f"flags-{kind}", flags.flag_classes(rows, self.census, kind, False))
            kept.select("flag").orderBy("flag").write.mode("overwrite").option("compression", "gzip").text(f"{self.folder.path}/flags-{kind}-text")
            n = kept.count()
            blind = n
            if self.m == self.n:
                blind = self._write(f"flags-{kind}-blind", flags.flag_classes(kept, self.census, kind, True)).count()
            return {"color_preserving": n, "color_blind": blind}

        return self.part(f"flags-{kind}", make)

    def flags_only(self, kind: str) -> dict:
        """Distinct labeled flags of a kind, by a last stage that builds no drawings; needs no final classes."""

        def make() -> dict:
            parents = census.classes(self.spark, self.m, self.n, f"{self.folder.path}/classes", stages=len(self.census.stages) - 1)
            sets = census.final_crossing_sets(self.spark, parents, self.m, self.n)
            rows = flags.labeled(flags.exported(sets, self.census)).where(F.col("kind") == kind)
            rows.select("flag").orderBy("flag").write.mode("overwrite").text(f"{self.folder.path}/flags-only-{kind}")
            return {"flags": self.spark.read.text(f"{self.folder.path}/flags-only-{kind}").count()}

        return self.part(f"flags-only-{kind}", make)

    def stage_counts(self) -> list[dict]:
        """Classes and crossings of each stage."""
        return self.part("stages", self._stage_counts)

    def _stage_counts(self) -> list[dict]:
        out = []
        for stage in range(len(self.census.stages)):
            path = census.stage_path(f"{self.folder.path}/classes", self.m, self.n, stage)
            rows = self.spark.read.schema(census.CLASS).parquet(path)
            out.append({"stage": stage} | rows.agg(F.count("*").alias("classes"), F.min("crossings").alias("least_crossings"), F.max("crossings").alias("most_crossings")).first().asDict())
        return out

    def cleanup(self) -> list[int]:
        """Delete the tables of all stages but the last, once the classes are done; returns the stages deleted.

        Resumption of the classes needs them no more; stage_counts() keeps what it counted in the record."""
        if self.record["parts"].get("classes", {}).get("status") != "done":
            raise ValueError("the classes are not done")
        self.stage_counts()
        gone = [s for s in range(len(self.census.stages) - 1) if self.folder.has(f"classes/K_{self.m}_{self.n}/stage={s}")]
        for s in gone:
            self.folder.delete(f"classes/K_{self.m}_{self.n}/stage={s}")
        return gone

    def run(self, reduce_flags: bool = True, keep_stages: bool = True) -> dict:
        """All parts, summary.json and report.md; returns the summary. Without keep_stages earlier stages' tables are deleted."""
        summary = {"m": self.m, "n": self.n, "strong": self.classes(), "exported_rows": self.export()}
        if reduce_flags:
            summary |= {k: self.flag_classes(k) for k in flags.KINDS}
        summary["stages"] = self.stage_counts()
        summary["checks"] = [list(v) for v in verdicts(summary)]
        self.folder.write("summary.json", json.dumps(summary, indent=1, sort_keys=True))
        self.folder.write("report.md", report(summary, self.record["parts"]))
        self.folder.append("log.jsonl", {"ended": utc_now(), "checks": summary["checks"]})
        if not keep_stages:
            self.cleanup()
        return summary


def report(summary: dict, parts: dict | None = None) -> str:
    lines = [f"# Census of K({summary['m']},{summary['n']})", "", "| count | color-preserving | color-blind |", "|---|---:|---:|"]
    for name in ("strong", *flags.KINDS):
        if got := summary.get(name):
            lines.append(f"| {name} | {got['color_preserving']} | {got['color_blind']} |")
    lines += ["", "| stage | classes | crossings |", "|---:|---:|---|"]
    lines += [f"| {s['stage']} | {s['classes']} | {s['least_crossings']}-{s['most_crossings']} |" for s in summary["stages"]]
    if parts:
        lines += ["", "| part | seconds | driver CPU seconds | driver peak MiB |", "|---|---:|---:|---:|"]
        lines += [f"| {k} | {p['seconds']:.1f} | {p.get('driver', {}).get('cpu_seconds', 0):.1f} | {p.get('driver', {}).get('max_rss_kib', 0) // 1024} |" for k, p in parts.items()]
    lines += ["", *(f"- {v}: {name} {got} (published {want})" for v, name, got, want in summary["checks"])]
    return "\n".join(lines) + "\n"
