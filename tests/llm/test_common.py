import re
from pathlib import Path

import pyarrow as pa
import pytest

from tonelake.llm import common


def held():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="Linux only")
def test_a_task_gives_back_what_it_freed():
    def run(batches):
        for n in batches:
            texts = [bytes(2000) for _ in range(n)]
            last = texts[-1:]
            del texts[::2]
            yield len(texts), last

    before = held()
    kept = list(common.released(run)(iter([50_000])))  # the last text lies above the freed ones, so the heap cannot shrink
    assert kept and held() - before < 40  # 100 MB were freed


def test_parts_are_the_same_rows():
    batch = pa.record_batch([pa.array(range(600))], names=["a"])
    cut = list(common.parts([batch, batch.slice(0, 0)], 256))
    assert [len(b) for b in cut] == [256, 256, 88] and pa.Table.from_batches(cut).column(0).to_pylist() == list(range(600))
    assert [x.as_py() for a in common.parts([pa.array(["x", None])], 1) for x in a] == ["x", None]
