"""Small corpora with the odd cases, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, length int, row int"
SYLLABLES = "an be co du er fi go ha in jo ka lu mi no or pa qui re su ti un va".split()


def prose(rng: random.Random, words: int) -> str:
    made = ("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(words))
    return re.sub(r"((?:\S+ ){11}\S+) ", r"\1.\n", " ".join(made))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(40, 160)) for _ in range(24)]
    passage = prose(rng, 60)
    out: list[str | None] = [None, "", " \n\t ", "word", "Two words", "É ü 中文 😀 ñ", "a" * 400, "ab" * 3000]
    out += base
    out += base[:3] + [base[3].replace(" ", "  "), base[4].upper()]
    for k in range(5, 10):  # near copies
        words = base[k].split(" ")
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += [f"{prose(rng, 50)} {passage} {prose(rng, 50)}" for _ in range(4)]
    out += [" ".join(f"{w}###" for w in prose(rng, 80).split()) for _ in range(4)]
    out += ["Same Same Same " * 30, "line one here\n" * 8 + "other line", prose(rng, 6000)]
    out += [base[0]] * 12  # a large group of copies
    return out


def frame(spark, values, first: int = 0):
    """Documents with columns whose names clash with those of the operators."""
    rows = [(first + k, t, "en", f"s{k % 2}", None if t is None else len(t), "x", 1, k)
            for k, t in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Null ids, repeated rows and repeated ids besides the usual texts."""
    rows = [(None, None), (None, "same null id"), (3, "twice the same row"), (3, "twice the same row"),
            (4, "one id"), (4, "other text of that id"), (5, ""), (6, None)]
    return spark.createDataFrame([(d, t, "en", "s", 1, "x", 1, 1) for d, t in rows], SCHEMA)


def words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def remainder(doc_id, n: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n
