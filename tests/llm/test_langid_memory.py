"""Memory of the language profiles stays bounded on diverse scripts and very long texts, and predictions equal a brute-force version's."""

import random
import subprocess
import sys

import numpy as np

from sparkloom.llm import langid

PROBE = """
import random, resource, sys
sys.path.insert(0, {root!r})
from sparkloom.llm import langid
rnd = random.Random(1)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{body}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def grown(body):
    root = __file__.rpartition("/tests/")[0]
    return int(subprocess.run([sys.executable, "-c", PROBE.format(root=root, body=body)], capture_output=True, text=True, check=True, timeout=600).stdout)


def test_memory_on_diverse_letters():
    assert grown("langid.bundle([''.join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(1000)) for _ in range(200)], 3, 512)") < 500


def test_memory_on_one_long_text():
    assert grown("langid.bundle([''.join(rnd.choices('abcdefgh ', k=2_000_000))], 3, 512)") < 500


def test_blocks_do_not_change_the_sums(monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(chr(rnd.randrange(0x4E00, 0x5000)) for _ in range(rnd.randint(0, 90))) for _ in range(30)] + ["abc def " * 40, None, ""]
    whole = langid.bundle(texts, 3, 64)
    for part, cells, grams in ((langid.PART, 400, 1 << 13), (langid.PART, langid.CELLS, 7), (11, langid.CELLS, langid.GRAMS)):
        monkeypatch.setattr(langid, "PART", part)
        monkeypatch.setattr(langid, "CELLS", cells)
        monkeypatch.setattr(langid, "GRAMS", grams)
        assert np.array_equal(langid.bundle(texts, 3, 64), whole)


def test_predictions_by_brute_force(spark):
    rnd = random.Random(6)
    sounds = {"aa": "bdgka", "bb": "mnlo", "cc": "strie"}
    rows = [(i, "".join(rnd.choice(sounds[lang] + "u ") for _ in range(rnd.randint(1, 60))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    vectors = {i: langid.bundle([t], 3, 128)[0].astype(float) for i, t, _ in rows}
    held = {r.doc_id: r.held_out for r in table.select("doc_id", langid.held_out().alias("held_out")).collect()}
    names = sorted(sounds)
    sums = np.array([sum(vectors[i] for i, _, lang in rows if lang == name and not held[i]) for name in names])
    sums /= np.linalg.norm(sums, axis=1)[:, None]
    for r in langid.train_and_predict(table, 3, 128).collect():
        v = vectors[r.doc_id]
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = sums @ v / np.linalg.norm(v)
        assert abs(r.score - max(0, cosine.max())) < 1e-5 and cosine[names.index(r.lang_pred)] > cosine.max() - 1e-5

