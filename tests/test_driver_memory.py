"""What a stage leaves in the driver's memory."""

from pathlib import Path

from siteglass.llm import common


def _resident_mb(pid: int) -> float:
    return int(Path(f"/proc/{pid}/statm").read_text().split()[1]) * 4096 / 1e6


def test_freed_native_memory_is_given_back(spark):
    jvm = spark.sparkContext._jvm
    pid, platform = int(jvm.java.lang.ProcessHandle.current().pid()), jvm.org.apache.spark.unsafe.Platform
    blocks = [platform.allocateMemory(100_000) for _ in range(2000)]
    for b in blocks:
        platform.setMemory(b, 1, 100_000)
    # the last block of an arena keeps those below it from being returned when they are freed
    for b in blocks[:-1]:
        platform.freeMemory(b)
    held = _resident_mb(pid)
    common.trim_native(spark)
    platform.freeMemory(blocks[-1])
    assert held - _resident_mb(pid) > 120


def test_storing_and_releasing_trim(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "trim_native", calls.append)
    common.discard(common.stored(spark.range(1), "one"))
    common.release(spark)
    assert len(calls) == 2
