"""Workers outlive a stage of the pipeline; what they remember must not add up over the stages."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from paperloom.llm import common
from paperloom.llm.jaccard import shingle_set
from paperloom.llm.substrings import runs
from paperloom.llm.token_ids import Encoder, default_path

WORDS = [b"word%d" % n for n in range(60)]


def test_a_stage_empties_what_the_others_remember():
    encoder = Encoder(default_path())
    ids = encoder.encode(b" ".join(WORDS))
    assert len(encoder.words) == 60
    shingles = shingle_set(b" ".join(WORDS), 5)
    assert not encoder.words and not encoder.pieces
    assert len(common._word_hashes) == 60
    assert encoder.encode(b" ".join(WORDS)) == ids
    assert len(encoder.words) == 60 and not common._word_hashes
    assert np.array_equal(shingle_set(b" ".join(WORDS), 5), shingles)


def test_operators_that_hash_words_share_one_memory():
    shingle_set(b" ".join(WORDS), 5)
    runs(WORDS, 35, 9)
    assert len(common._word_hashes) == 60


def test_a_full_memory_starts_anew():
    memory = common.Remembered("test", len, 10)
    assert [memory[b"x" * n] for n in range(25)] == list(range(25))
    assert len(memory) <= 10


GROWN = """
import ctypes, re
assert hasattr(ctypes.CDLL(None), "malloc_trim")
import numpy as np
{setup}
def held(name):
    return int(re.search(name + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
open("/proc/self/clear_refs", "w").write("5")
before = held("RssAnon")
{work}
print(held("{name}") - before - {files})
"""


def grown(name, setup, work, files="0"):
    """MB that a fresh process has more after ``work``."""
    code = GROWN.format(name=name, setup=setup, work=work, files=files)
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2])
    if "malloc_trim" in run.stderr or "clear_refs" in run.stderr:
        pytest.skip("only where glibc's memory can be measured")
    assert run.returncode == 0, run.stderr
    return float(run.stdout)


def test_what_a_stage_remembered_goes_back_to_the_system():
    """One value kept above the emptied ones held all 120 MB of them with the worker."""
    setup = """
from paperloom.llm.common import Remembered
one, other = Remembered("one", lambda key: bytes(4_000), 30_000), Remembered("other", lambda key: bytes(4_000), 30_000)"""
    work = """
for key in range(30_000): one[key]
kept = bytes(4_000)
other[0]"""
    assert grown("RssAnon", setup, work) < 30


def test_signatures_are_packed_in_little_memory():
    """A flush sorts copies of all it holds: a million signatures took over 100 MB."""
    setup = """
from paperloom.llm.jaccard import HELD_SIGNATURES, _packed"""
    work = """
ids = np.arange(0, HELD_SIGNATURES // 200)
entries = [(np.random.default_rng(n).integers(0, 1 << 62, 200, np.uint64), np.full(200, n)) for n in ids]
for row in _packed(entries, 408): pass"""
    assert grown("VmHWM", setup, work, 'held("RssFile")') < 90


def test_stages_bound_their_batches(spark):
    import corpus_pipeline

    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    corpus_pipeline._plain(spark.createDataFrame([], "doc_id long, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == common.BATCH_BYTES
