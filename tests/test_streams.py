"""Folding of answers: against its definition over any cut into batches, what a batch writes, and timers."""

import random
import time
from pathlib import Path

from docproof.streaming import jobs as J

EVENT = "question_id long, seq long, type string, block long, text string, valid boolean, stop_reason string"


def arriving(spark, folder, batches):
    """One file a batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(folder))
        for f in Path(folder).glob("part-*.parquet"):
            if not f.name.startswith("part-b"):
                f.rename(f.with_name(f"part-b{i:03}.parquet"))
        time.sleep(0.01)
    return J.stream(spark, str(folder), files_per_batch=1)


def test_answers_over_batches(spark, tmp_path):
    r, events, want = random.Random(5), [], {}
    for q in range(12):
        texts = [(seq, r.randint(1, 3), r.choice([" a ", "b", "", "\n", "c d"])) for seq in range(r.randint(0, 7))]
        cited, stop = r.randint(0, 2), r.choice([None, "end_turn", "refusal", "error"])
        blocks = {}
        for _, block, text in sorted(texts):
            blocks[block] = blocks.get(block, "") + text
        answer = "\n".join(x.strip() for x in blocks.values() if x.strip()) or None
        want[q] = ("failed" if stop in ("refusal", "error") else "answered" if cited else "unanswered", answer, cited)
        own = [(q, s, "text", b, t, False, None) for s, b, t in texts] + [(q, 50 + i, "citation", 1, None, i < cited, None) for i in range(3)]
        r.shuffle(own)
        cuts = sorted(r.randint(0, 3) for _ in own)
        events += list(zip(cuts, own)) + [(3, (q, 99, "finished", 0, None, False, stop))]
    events.append((1, (77, 1, "text", 1, "never done", False, None)))
    batches = [[e for at, e in events if at == b] for b in range(4)]
    got = J.available_now(J.answers(arriving(spark, tmp_path / "in", batches)), str(tmp_path / "out"), str(tmp_path / "state"), conf=J.APPENDED_STATE)
    assert {x.question_id: (x.status, x.answer, x.citations) for x in got.collect()} == want
    assert got.count() == len(want)


def test_a_batch_writes_what_is_new(spark, tmp_path):
    """Twelve batches of one long answer: what each adds to the state does not grow with the answer."""
    r = random.Random(1)
    batches = [[(1, 10 * b + i, "text", 1, "".join(r.choices("abcdefghij", k=2000)), False, None) for i in range(10)] for b in range(12)]
    J.available_now(J.answers(arriving(spark, tmp_path / "in", batches)), str(tmp_path / "out"), str(tmp_path / "state"), conf=J.APPENDED_STATE)
    sizes = {}
    for f in (tmp_path / "state" / "state").rglob("*.changelog"):
        version = int(f.name.split("_")[0].split(".")[0])
        sizes[version] = sizes.get(version, 0) + f.stat().st_size
    assert len(sizes) >= 11 and min(sizes.values()) > 5_000
    assert max(sizes.values()) < 1.5 * sizes[min(sizes)]


def test_silent_answers_fail_by_timer(spark, tmp_path):
    rows = arriving(spark, tmp_path / "in", [[(1, 1, "text", 1, "half", False, None), (2, 1, "text", 1, "whole", False, None), (2, 2, "finished", 0, None, False, None)]])
    out = str(tmp_path / "out")
    with J.settings(spark, J.APPENDED_STATE):
        running = J.answers(rows, timeout_ms=1000).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").format("parquet").start(out)
    try:
        end = time.time() + 90
        while time.time() < end and (not Path(out, "_spark_metadata").exists() or spark.read.schema(J.ANSWER).parquet(out).count() < 2):
            time.sleep(1)
    finally:
        running.stop()
    assert sorted((x.question_id, x.status, x.answer) for x in spark.read.schema(J.ANSWER).parquet(out).collect()) == [(1, "failed", None), (2, "unanswered", "whole")]
