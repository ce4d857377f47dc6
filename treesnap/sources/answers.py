"""Model answers that outlive a failed run.

An answer store is a shared folder. The tasks that ask a model write each
answer down as it comes, as a JSON line in a file of their own, so a task, a
stage or a driver that dies loses at most the call it is waiting for. A task that
is repeated reads what its earlier attempts wrote and asks for the rest, and so
does the next run for whatever any run has written. Every line also tells the
tokens that the model reported, so the lines are the call log, and each answered
call stands in it once.

- ``calls/<run>/<partition>/<attempt>-<n>.jsonl``: project, item, sha256, answer,
  error, input_tokens, output_tokens, run, end (always true: a line that was cut
  off has none and does not count)
- ``calls/<run>/_done``: written when all tasks of the run have ended well
- ``settled/``: the lines of finished runs as parquet, see ``settle``

Files are written through Arrow's file systems: mounted paths, hdfs://, s3:// and
gs://. Lines are flushed call by call; where the storage shows a file only when it
is closed, ``roll=1`` closes one per call."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from treesnap.operators.describe import CALL_ROWS, ask_prompts
from treesnap.operators.usage import usage

KEYS = ["project", "item", "sha256"]
LINE = "project string, item string, sha256 string, answer string, error string, input_tokens long, output_tokens long, run string, end boolean"
ROLL = 64    # calls in one file


@dataclass
class Asked(WriterCommitMessage):
    partition: int
    asked: int      # prompts sent to the model by the attempt that counts
    found: int      # prompts that an earlier attempt had answers to


def file_system(folder: str):
    """The Arrow file system of a folder and the folder's path in it."""
    from pyarrow import fs
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def read_lines(store, folder: str) -> Iterator[dict]:
    """The whole lines of the files in a folder, none if there is no folder."""
    from pyarrow import fs
    for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.base_name.endswith(".jsonl"):
            with store.open_input_stream(info.path) as f:
                for line in f.read().decode("utf-8").split("\n"):
                    try:
                        found = json.loads(line)
                    except ValueError:
                        continue   # the last line of an attempt that was cut off
                    yield found


def answer_sink(folder: str, run: str, complete: Callable, max_tokens: int, call_rows: int = CALL_ROWS, roll: int = ROLL) -> type[DataSource]:
    """A data source that asks the model for the rows written to it (project,
    item, sha256, prompt) and keeps the answers."""

    class AnswerWriter(DataSourceWriter):
        def write(self, iterator) -> Asked:
            store, root = file_system(folder)
            context = TaskContext.get()
            partition, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
            own = f"{root}/calls/{run}/{partition}"
            answered = {tuple(x[k] for k in KEYS) for x in read_lines(store, own) if x["answer"] is not None}
            store.create_dir(own, recursive=True)
            held, out, asked, found, calls = [], None, 0, 0, 0

            def call():
                nonlocal out, asked, calls
                got = ask_prompts(complete, [r["prompt"] for r in held], max_tokens)
                lines = [json.dumps({**{k: r[k] for k in KEYS}, "answer": text, "error": error, "input_tokens": given, "output_tokens": taken, "run": run, "end": True},
                                    ensure_ascii=False) for r, (text, error, given, taken) in zip(held, got, strict=True)]
                if calls % roll == 0:
                    if out:
                        out.close()
                    out = store.open_output_stream(f"{own}/{attempt}-{calls // roll}.jsonl")
                out.write("".join(x + "\n" for x in lines).encode("utf-8", "replace"))
                out.flush()
                asked, calls = asked + len(held), calls + 1
                held.clear()

            try:
                for row in iterator:
                    if tuple(row[k] for k in KEYS) in answered:
                        found += 1
                        continue
                    held.append(row)
                    if len(held) == call_rows:
                        call()
                if held:
                    call()
            finally:
                if out:
                    out.close()
            return Asked(partition, asked, found)

        def commit(self, messages) -> None:
            store, root = file_system(folder)
            store.create_dir(f"{root}/calls/{run}", recursive=True)
            done = [m for m in messages if m is not None]
            with store.open_output_stream(f"{root}/calls/{run}/_done") as f:
                f.write(json.dumps({"tasks": len(done), "asked": sum(m.asked for m in done), "found": sum(m.found for m in done)}).encode())

        def abort(self, messages) -> None:
            """Nothing is taken back: what was answered is paid for."""

    class AnswerSink(DataSource):
        @classmethod
        def name(cls):
            return f"answers_{run.replace('-', '_')}"

        def writer(self, schema, overwrite):
            return AnswerWriter()

    return AnswerSink


class AnswerStore:
    """The answers under a folder, and the way to get more."""

    def __init__(self, spark: SparkSession, folder: str, roll: int = ROLL):
        self.spark, self.folder, self.roll = spark, folder.rstrip("/"), roll

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _has(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def lines(self) -> DataFrame:
        """Everything written down, by all runs."""
        found = self.spark.createDataFrame([], LINE)
        if self._has("settled"):
            found = found.unionByName(self.spark.read.schema(LINE).parquet(f"{self.folder}/settled"))
        if self._has("calls"):
            settled = found.select("run").distinct()
            calls = self.spark.read.schema(LINE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(f"{self.folder}/calls")
            found = found.unionByName(calls.where("end and sha256 is not null").join(settled, "run", "left_anti"))
        return found

    def answers(self) -> DataFrame:
        """project, item, sha256, answer: one per key, of several the first by run."""
        return (self.lines().where("answer is not null").groupBy(*KEYS)
                .agg(F.min(F.struct("run", "answer")).alias("x")).select(*KEYS, "x.answer"))

    def usage(self, by: list[str] = ("run", "project")) -> DataFrame:
        """Tokens and answered prompts, summed over the log."""
        calls = self.lines().where("answer is not null").withColumn("is_call", F.lit(True))
        return usage(calls.fillna(0, ["input_tokens", "output_tokens"]), list(by))

    def ask(self, rows: DataFrame, complete: Callable, max_tokens: int, tasks: int, call_rows: int = CALL_ROWS) -> DataFrame:
        """As ``describe.call_model``: the columns of ``rows`` without
        ``prompt``, plus answer and error. Prompts whose answers are stored are not
        asked again. A prompt is known by its project, its path (or what it
        asks for and its part) and the hash of its content (or of itself)."""
        names = rows.columns
        item = F.col("path") if "path" in names else F.concat_ws("/", "what", F.col("part").cast("string"), F.lit(str(max_tokens)))
        sha = F.col("sha256") if "sha256" in names else F.sha2("prompt", 256)
        keep = [c for c in names if c != "prompt"]
        keyed = rows.select(F.struct(*keep).alias("_row"), F.col("project").alias("project"), item.alias("item"), sha.alias("sha256"), "prompt")
        run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        todo = keyed.join(self.answers().select(*KEYS), KEYS, "left_anti").select(*KEYS, "prompt")
        sink = answer_sink(self.folder, run, complete, max_tokens, call_rows, self.roll)
        self.spark.dataSource.register(sink)
        todo.repartition(tasks).write.format(sink.name()).mode("append").save()
        failed = self.lines().where((F.col("run") == run) & F.col("answer").isNull()).groupBy(*KEYS).agg(F.min("error").alias("error"))
        got = keyed.drop("prompt").join(self.answers(), KEYS, "left").join(failed, KEYS, "left")
        return got.select("_row.*", "answer", F.when(F.col("answer").isNull(), F.coalesce("error", F.lit("no answer"))).alias("error"))

    def settle(self) -> int:
        """Move the lines of finished runs into a few parquet files; returns
        how many runs. Lines of settled runs are read from there alone, so a
        failure between the two steps counts nothing twice."""
        if not self._has("calls"):
            return 0
        path, fs = self._path("calls")
        done = [s.getPath() for s in fs.listStatus(path) if self._path(f"calls/{s.getPath().getName()}/_done")[1].exists(self._path(f"calls/{s.getPath().getName()}/_done")[0])]
        known = {r["run"] for r in self.spark.read.schema(LINE).parquet(f"{self.folder}/settled").select("run").distinct().collect()} if self._has("settled") else set()
        for p in done:
            run = p.getName()
            if run not in known:
                lines = self.spark.read.schema(LINE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(f"{self.folder}/calls/{run}")
                lines.where("end and sha256 is not null").write.mode("append").parquet(f"{self.folder}/settled")
            fs.delete(p, True)
        return len(done)
