import re
import sys
from pathlib import Path

import pytest

from plainword.llm.common import tidy


def native_mb(pid: int) -> float:
    """Touched memory of a JVM beside its heap, which stands at low addresses."""
    parts = re.findall(r"^(\w+)-\w+ .*\n(?:\w+:.*\n)*?Anonymous: +(\d+)", Path(f"/proc/{pid}/smaps").read_text(), re.M)
    return sum(int(kb) for at, kb in parts if int(at, 16) >= 1 << 40) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_tidy_returns_freed_native_memory(spark):
    """What 1,000 deflaters held and freed, below one that lives on, stays with the C library until it is told to let go."""
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    tidy(spark)
    before = native_mb(pid)
    some = [jvm.java.util.zip.Deflater() for _ in range(1000)]
    full = native_mb(pid)
    for d in some[:-1]:
        d.end()
    jvm.System.gc()
    freed = native_mb(pid)
    tidy(spark)
    after = native_mb(pid)
    some[-1].end()
    assert full - before > 20
    assert after - before < (full - before) / 2 < freed - before
