"""Documents with everything that may go wrong in a table, for all operators."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, key string, content string, tokens int, epoch string, hash string, spans string, chunk long"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(WORDS[(x >> 33) % len(WORDS)])
    return " ".join(out)


PASSAGE = prose(99, 60)

TEXTS = {
    1: prose(1, 80), 2: prose(1, 80), 3: prose(1, 78) + " other words", 4: None, 5: "", 6: " \t\n ", 7: "one two", 8: "One  TWO",
    9: prose(2, 40) + " " + PASSAGE, 10: PASSAGE + " " + prose(3, 40), 11: "a " * 60, 12: "a " * 45 + "b", 13: "ab cd " * 40,
    14: prose(4, 6000), 15: prose(5, 300) + " " + prose(4, 500), 16: "x" * 50_000, 17: prose(1, 80).upper(),
    18: "äöü ß 漢字 😀 " * 5, 19: prose(6, 13), 20: prose(6, 13), 21: prose(6, 12), 22: prose(7, 5), 23: prose(7, 4), 24: prose(7, 4),
}


def odd_documents(spark, partitions: int = 3):
    rows = [(k, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"src{k % 4}", None if t is None else len(t)) for k, t in TEXTS.items()]
    rows += [(1, TEXTS[1], "en", "src1", 1), (None, TEXTS[1], "en", None, None), (None, None, None, None, None)]
    rows = [r + (0.5, 7, "k", None, 3, "e", "h", "s", 1) for r in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
