"""Training values of the secret scan."""

from lodestone.llm import secrets


def test_every_label_has_its_own_share(spark):
    hashes = " ".join(f"{k:016x}" for k in range(17_000))
    plain = " ".join(f"ordinary-token-number-{k}" for k in range(300))
    formats = secrets.train(spark.createDataFrame([(1, hashes), (2, plain)], "doc_id long, text string"))
    assert formats.good and formats.plain is not None
