import random

from helpers import prose
from lingua_spark.llm import secrets


def test_noise_after_equals_signs(spark):
    """Runs directly after '=' are candidates: NAME=noise, ?sig=noise, noise with padding before '='."""
    rng = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    noise = ["".join(rng.choice(alphabet) for _ in range(64)) for _ in range(60)]
    before = ["PRIVATE_KEY=", "aws_access_key=", "https://a.example/x?sig=", "a==", "SESSION= ", ""]
    rows = [(i, f"{prose(rng, 5)} {before[i % 6]}{t} end") for i, t in enumerate(noise)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    right = [0] * 6
    for r in secrets.secret_spans(docs).collect():
        i, text = rows[r["doc_id"]]
        spans = [text[s["start"]:s["end"]] for s in r["spans"] if s["kind"] == 3]
        right[i % 6] += noise[i] in spans
    assert min(right) >= 7
