from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from helpers import prose
from lingua_spark.llm import lm_scoring as lm

import random


def test_updates_per_word(monkeypatch):
    """Every 512 words of a round make an update of the layer of 32."""
    steps = []
    monkeypatch.setattr(lm.Trainer, "train", lambda self, around, target: steps.append((len(target), self.net.bias.shape[0])))
    rng = np.random.default_rng(0)
    net = lm.Net(rng.standard_normal((4, lm.CLASSES + 1, lm.WIDTH)), np.zeros(lm.WIDTH), rng.standard_normal((lm.WIDTH, lm.CLASSES)), np.zeros(lm.CLASSES))
    vocab = lm.Vocabulary(np.ones(lm.SLOTS, np.int16), np.zeros(lm.SLOTS, np.float32), np.zeros(lm.CLASSES))
    batch = pa.RecordBatch.from_arrays([pa.array([prose(random.Random(1), 4096)])], ["text"])
    list(lm._train(SimpleNamespace(value=net.flat()), SimpleNamespace(value=vocab), 0)(iter([batch])))
    assert steps == [(512, 32)] * 4
