import subprocess
import sys

import pytest

GIVES_BACK = """
import re
from febrile.llm.common import tidy

def anon():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

last = []

def step(batches):
    held = [b"x" * 400 + bytes(300) for _ in range(150_000)]
    last.append(bytes(700))  # stays behind, at the end of the heap
    yield from batches

before = anon()
assert list(tidy(step)(iter([1, 2]))) == [1, 2]
print(anon() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_worker_gives_back_what_a_step_no_longer_uses():
    out = subprocess.run([sys.executable, "-c", GIVES_BACK], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert float(out.stdout) < 30  # 100 MB without
