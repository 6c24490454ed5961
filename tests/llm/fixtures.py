"""Documents with the odd cases: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, node long, kept string, slot long, `at` string, hash long"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    parts = ["an", "be", "co", "de", "él", "fu", "go", "hi", "ße", "ja"]
    words = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 4))) for _ in range(n)]
    for i in range(7, n, 9):
        words[i] += draw.choice([",", ".", ".\n", "\n", "!"])
    return " ".join(words)


def odd_rows() -> list[tuple]:
    plain = prose(1, 120)
    texts = {
        1: plain,
        2: plain,
        3: plain.replace("an ", "xx ", 1),
        4: None,
        5: "",
        6: " \t\n ",
        7: "one",
        8: prose(2, 60) + "\n" + prose(3, 60),
        9: "spam spam spam " * 40,
        10: prose(4, 30_000),
        11: "MIT License\n" + prose(5, 70) + "\nReleased under the MIT License.",
        12: prose(6, 200),
        13: "#a| *b* $c% d&e <f>\n\na\nA\na" + prose(7, 55),
    }
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in texts.items()]
    rows += [rows[0], rows[0]]  # repeated rows
    rows += [(12, prose(8, 90), None, None, None)]  # an id with another text
    rows += [(None, prose(9, 80), None, "src0", 1), (None, None, None, None, None)]
    return [(*r, 1, 2, "x", 3, "y", 4) for r in rows]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
