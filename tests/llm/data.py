"""Small tables for the tests of the training-text operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, chunk long"


def corpus(seed=5, n=120, words=400):
    """Documents with exact and near copies, shared passages, odd white space, empty, null and very long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7))) for _ in range(words)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for k in range(n):
        kind = rng.random()
        own = [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        if texts and kind < 0.15:
            text = rng.choice(texts)
        elif texts and kind < 0.4:
            words_ = (rng.choice([t for t in texts if t]) or "x").split()
            for _ in range(rng.randint(0, 3)):
                if words_:
                    words_[rng.randrange(len(words_))] = rng.choice(vocabulary)
            text = " ".join(words_)
        elif kind < 0.6:
            text = " ".join(own) + rng.choice([" ", "\n", "\t\x0b "]) + passage
        else:
            text = " \n".join(own)
        texts.append(text)
    texts[3] = None
    texts[7] = ""
    texts[11] = " \t\r\n"
    texts[13] = "One  two\x0bthree"
    texts[17] = "oNE two THREE"
    texts[19] = "nul\x00 byte and   odd"
    texts[23] = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    texts[29] = texts[23]
    ids = list(range(0, 3 * n, 3))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def documents(spark, rows):
    """A table of documents with further columns named like results."""
    return spark.createDataFrame([(i, t, "xx", f"s{(i or 0) % 3}", len(t) if t else None, "k", 0.5, 1) for i, t in rows], SCHEMA).repartition(3)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}
