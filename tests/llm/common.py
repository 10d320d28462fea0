"""Small tables for the tests of this subpackage."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def docs(spark, texts, lang="en", source="s"):
    """Rows (doc_id by place) for texts, with columns that clash with names used inside the operators."""
    names = ["row", "size", "tag", "n", "key", "part", "w", "lines", "h", "score", "first", "region", "bucket", "blob", "_text", "document", "kind", "position"]
    rows = [(i, t, lang, source if isinstance(source, str) or source is None else source[i], len(t or ""), *["x"] * len(names)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + "".join(f", {x} string" for x in names)).repartition(3)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(prose(rng, 1) if rng.random() < share else w for w in text.split(" "))


ODD = [None, "", "   ", "\n\t", "a", "a b c d", "a b c d e", "A B c D e", "é ü 日本語 ٣ \U0001f600", "\x1c x\x1dy", "a  b\t\tc \n d", "word " * 5000, "x" * 100_000, "!!! 123 ...", "same text here for two rows", "same text here for two rows"]
