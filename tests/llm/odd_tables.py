"""Small tables with everything that may be odd: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = "thon erat ingsh bleou nder ansti heor whathe reed oust tione ésti ñora über anlich eauon".split()
#: Names that operators use for columns of their own or of their results.
CLASHING = ["key", "_row_key", "_found", "h", "fp", "digest", "shard", "slot", "bucket", "ids", "node", "root", "label", "score", "_words", "win", "lead"]
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9) if rng.random() < 0.3 else "") for _ in range(n))


def odd_rows():
    passage = prose(99, 90)  # over 400 bytes
    long_text = prose(5, 9000)
    texts = [
        (0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, prose(1, 30)), (5, prose(2, 120)), (6, prose(2, 120)), (7, prose(2, 119) + " end"),
        (8, prose(3, 40) + "\n" + passage + "\n" + prose(4, 30)), (9, passage), (10, prose(6, 25) + " " + passage + " " + prose(7, 20)),
        (11, "ab " * 400), (12, long_text), (13, "x" * 3000), (14, "naïve 🙂 ▁ <|turn|> \\ text. Two! Three? four"), (14, "same id, other text of some words"),
        (15, prose(8, 60)), (15, prose(8, 60)), (None, prose(9, 50)), (None, prose(9, 50)), (None, None), (16, prose(2, 120)),
    ]
    return [(i, t, None if n % 3 else "en", None if n % 4 else "src0", None, *["clash"] * len(CLASHING)) for n, (i, t) in enumerate(texts)]
