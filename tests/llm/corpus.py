"""Small corpora for the tests: shared passages, copies, odd rows."""

import random


def texts(seed: int, n: int, words: int = 60, passages: int = 4) -> list[str]:
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(400)]
    shared = [" ".join(r.choice(vocab) for _ in range(r.randint(13, 40))) for _ in range(passages)]
    out = []
    for _ in range(n):
        kind = r.random()
        if out and kind < 0.15:
            out.append(r.choice(out))
            continue
        parts = [r.choice(vocab) for _ in range(r.randint(0, words))]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, len(parts)), r.choice(shared))
        out.append("".join(p + r.choice([" ", " ", "\n", "  "]) for p in parts))
    return out


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long, chunk long, keys string"):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(3)


ODD = [None, "", " ", "\n\n", "a", "é", "x " * 3000, "word"]
