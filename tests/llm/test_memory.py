import subprocess
import sys

import pytest

CODE = """
import numpy as np
import pyarrow as pa
from palio.llm import _repeats, similar

class Docs:  # gives the function that tasks run
    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run

def resident():
    return int(open('/proc/self/statm').read().split()[1]) * 4096

run = {"repeats": lambda: _repeats.find_blocks(Docs(), _repeats.word_symbols, 20, 5, True), "sets": lambda: similar._digests(Docs(), 5)}[TASK]()
text = ' '.join(f'w{i}' for i in range(60))
batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text])], names=['_id', '_text'])
arrays = [np.ones(12_000) for _ in range(2_500)]  # below the size that the C library maps by itself
keep = arrays[-1]
del arrays  # freed in pieces below one that stays, as after an earlier task of a reused worker
held = resident()
assert sum(len(b) for b in run(iter([batch])))
assert resident() < held - 150_000_000, (held, resident())
"""


@pytest.mark.parametrize("task", ["repeats", "sets"])
def test_a_task_gives_back_what_its_reused_worker_holds(task):
    subprocess.run([sys.executable, "-c", f"TASK = {task!r}\n{CODE}"], check=True)


PACKING = """
import random
from unittest import mock
import pyarrow as pa
from palio.llm import _tokens, packing

class Docs:  # gives the function that tasks run
    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run

def resident():
    return int(open('/proc/self/statm').read().split()[1]) * 4096

packing.F = mock.MagicMock()
run = packing.pieces(Docs(), _tokens.default_path(), 'doc_id', 'text', 2, 1024)
draw = random.Random(5)

def batches():
    for i in range(8):  # 100 new words a document
        texts = [' '.join(''.join(draw.choices('abcdefghij', k=9)) for _ in range(100)) for _ in range(1000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(1000 * i, 1000 * i + 1000)), pa.array(texts)], names=['doc', 'text'])

given = list(batches())
before = resident()
most = rows = 0
for b in run(iter(given)):
    rows += len(b)
    most = max(most, resident())
assert rows == 8000
assert most < before + 110_000_000, (most - before) >> 20
"""


def test_packing_remembers_few_units():
    subprocess.run([sys.executable, "-c", PACKING], check=True)
