"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeats, clashing names."""

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly box five jumping frogs near old stone bridges at dawn".split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, fp string, node string, key string, target string, size string, _doc string"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed: int, n: int = 60) -> str:
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def rows() -> list[tuple]:
    base = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(40)]
    base += [(100 + i, text(3), "en", "s0", 1) for i in range(10)]  # copies
    base += [(120, text(3).replace(" ", "\t\n"), "en", "s1", 1), (121, " " + text(3), "en", "s1", 1)]
    long = text(5, 400)
    base += [(130 + i, long.replace("0", str(i), 1), "en", "s2", 1) for i in range(5)]  # near copies
    base += [(150, None, None, None, None), (151, "", "en", "s1", 0), (152, " \n ", "en", None, 3), (None, text(8), "en", "s1", 1), (None, None, "en", "s2", 1)]
    base += [(160, "twice", "en", "s0", 1), (160, "twice", "en", "s0", 1), (160, "other", "en", "s0", 1), (161, "one two three four", "de", "é", 1), (162, "ONE two\tthree four", "de", "é", 1)]
    base += [(170, text(11, 6000), "en", "s1", 1), (171, "x" * 50_000, "en", "s1", 1), (172, "日本語 のテキスト \U0001f600 ok", "ja", "s1", 1)]
    return base


def documents(spark):
    return spark.createDataFrame([(*r, *"clashes"[:7]) for r in rows()], SCHEMA).repartition(5)


def plain(spark):
    return spark.createDataFrame(rows(), DOC).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOC)
