"""Model answers that survive failed tasks, failed runs and repeated ones."""

import os

import pytest

from treesnap.operators import describe as DS
from treesnap.plans import build as B
from treesnap.sources.answers import AnswerStore, answer_sink, file_system, read_lines

EMPTY = ("project string, path string, sha256 string, description string", "project string, use_cases string, conventions_ai string")


def counting(folder, die_after=None):
    """A model that leaves a mark for every prompt; its process ends after so many."""
    def complete(prompts, max_tokens):
        out = []
        for p in prompts:
            n = len(os.listdir(folder))
            if die_after is not None and n >= die_after:
                os._exit(1)
            open(os.path.join(folder, f"{n:04d}-{os.getpid()}-{abs(hash(p))}"), "w").close()
            out.append((f"  About {p.split('Path: ')[-1].splitlines()[0]}.  ", len(p), 7))
        return out
    return complete


def prompts(spark, n):
    return spark.createDataFrame([("p", f"f{i}.py", f"h{i}", f"Path: f{i}.py\n") for i in range(n)], "project string, path string, sha256 string, prompt string")


def test_a_killed_run_is_continued(spark, tmp_path):
    store, marks = AnswerStore(spark, str(tmp_path / "answers")), str(tmp_path / "marks")
    os.mkdir(marks)
    with pytest.raises(Exception):
        store.ask(prompts(spark, 40), counting(marks, die_after=23), 64, 2, call_rows=1)
    kept = store.answers().count()
    assert 20 <= kept <= 23   # a call in flight may be lost
    before = len(os.listdir(marks))
    got = store.ask(prompts(spark, 40), counting(marks), 64, 2, call_rows=4).collect()
    assert len(os.listdir(marks)) - before == 40 - kept
    assert {r["path"]: r["answer"] for r in got} == {f"f{i}.py": f"About f{i}.py." for i in range(40)} and all(r["error"] is None for r in got)
    # a third run asks for what changed alone
    changed = prompts(spark, 41).replace("h3", "new")
    before = len(os.listdir(marks))
    assert store.ask(changed, counting(marks), 64, 2).where("answer is null").count() == 0
    assert len(os.listdir(marks)) - before == 2
    # the log counts every answered prompt once, whatever failed
    assert [(r["calls"], r["output_tokens"]) for r in store.usage(["project"]).collect()] == [(42, 42 * 7)]
    lines = sorted(map(str, store.lines().collect()))
    assert store.settle() == 2 and sorted(map(str, store.lines().collect())) == lines
    assert store.settle() == 0 and store.ask(prompts(spark, 40), counting(marks, die_after=0), 64, 2).where("answer is null").count() == 0


def test_a_repeated_task_asks_for_the_rest(tmp_path):
    folder, seen = str(tmp_path), []

    def complete(prompts, max_tokens):
        if len(seen) == 5:
            seen.append(None)
            raise KeyboardInterrupt   # the worker is stopped
        seen.extend(prompts)
        return [p.upper() for p in prompts]

    rows = [{"project": "p", "item": f"i{i}", "sha256": "h", "prompt": f"ask {i}"} for i in range(9)]
    writer = answer_sink(folder, "run1", complete, 8, call_rows=1)({}).writer(None, False)
    with pytest.raises(KeyboardInterrupt):
        writer.write(iter(rows))
    with open(tmp_path / "calls/run1/0/0-0.jsonl", "a") as f:
        f.write('{"project": "p", "item": "i5", "sha')   # cut off
    os.rename(tmp_path / "calls/run1/0/0-0.jsonl", tmp_path / "calls/run1/0/9-0.jsonl")   # as of another attempt
    done = writer.write(iter(rows))
    assert (done.asked, done.found) == (4, 5)
    writer.commit([done])
    assert [x for x in seen if x] == [f"ask {i}" for i in range(9)]
    store, root = file_system("file:" + folder)
    assert sorted((x["item"], x["answer"]) for x in read_lines(store, f"{root}/calls/run1/0")) == [(f"i{i}", f"ASK {i}".upper()) for i in range(9)]


def test_failed_prompts_are_asked_again(spark, tmp_path):
    store, state = AnswerStore(spark, str(tmp_path)), {"bad": True}

    def fails(prompts, max_tokens):
        if any("f2.py" in p for p in prompts):
            raise RuntimeError("no")
        return ["ok"] * len(prompts)

    got = {r["path"]: (r["answer"], r["error"]) for r in store.ask(prompts(spark, 5), fails, 64, 2).collect()}
    assert got["f2.py"] == (None, "RuntimeError: no") and got["f1.py"] == ("ok", None)
    again = store.ask(prompts(spark, 5), lambda p, n: ["later"] * len(p), 64, 2).collect()
    assert {r["path"]: r["answer"] for r in again} == {f"f{i}.py": "later" if i == 2 else "ok" for i in range(5)}


def test_build_reads_answers_before_asking(spark, tmp_path, project_files):
    marks, answers = str(tmp_path / "marks"), str(tmp_path / "answers")
    os.mkdir(marks)
    cache, synthesis = (spark.createDataFrame([], s) for s in EMPTY)
    settings = B.BuildSettings(complete=counting(marks), answers=answers, generated_at="2026-01-01T00:00:00+00:00")
    first = B.build(project_files, cache, synthesis, settings)
    lines = [r["line"] for r in first.document_lines.orderBy("project", "sec", "ord").collect()]
    asked = len(os.listdir(marks))
    assert asked == 4 + 2   # four files, two texts of the project
    # the run was lost before anything was written: the next one asks for nothing
    again = B.build(project_files, cache, synthesis, settings)
    assert len(os.listdir(marks)) == asked
    assert [r["line"] for r in again.document_lines.orderBy("project", "sec", "ord").collect()] == lines
    use = {r["project"]: (r["calls"], r["output_tokens"]) for r in AnswerStore(spark, answers).usage(["project"]).collect()}
    assert use == {"proj": (6, 42)}


def test_models_may_tell_tokens_or_not():
    assert DS.ask_prompts(lambda p, n: [" a ", ("b", 3, None)], ["x", "y"], 5) == [("a", None, 0, 0), ("b", None, 3, 0)]
    assert DS.ask_prompts(lambda p, n: ["a"], ["x", "y"], 5) == [("a", None, 0, 0), ("a", None, 0, 0)]
