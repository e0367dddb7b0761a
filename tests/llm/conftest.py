import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """n words that look random but are the same in each run, a line feed after every tenth."""
    out, x = [], seed * 7919 + 13
    for k in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"{WORDS[x % len(WORDS)]}{(x >> 8) % 97}" + ("\n" if k % 10 == 9 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def texts() -> dict[int, str | None]:
    """Plain, copied, edited, empty, null, blank, short, very long and odd texts."""
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join(w if k % 7 else "other" for k, w in enumerate(words))
    return {
        1: base, 2: base, 3: near, 4: far, 5: "", 6: None, 7: " \t\n ", 8: "one two three", 9: "One two THREE", 10: prose(2, 4000),
        11: "x" * 30_000, 12: "mail a.b+c@d-e.fr, a@b@c.de 1.2.3.4 999.1.1.1, 4111 1111 1111 1111 +1 (555) 123-4567 token = \"ab12cd34ef\" https://x.org/a?b=1.",
        13: "Éé ü ß 中文字 \U0001f600 a b <|endoftext|> \x00 end", 14: "### $$$ word*** " * 60, 15: "HELLO!! " * 80, 16: " | ".join(WORDS * 5), 17: "same line\n" * 60, 18: prose(3, 200), 19: prose(4, 75), 20: prose(5, 90),
    }


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with further columns, one of which has a name that the operators use themselves."""
    rows = [(i, t, "en", "src0", len(t or ""), "kept") for i, t in texts.items()]
    rows += [(20, texts[20], "en", "src0", 5, "kept"), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("doc_id < 0")
