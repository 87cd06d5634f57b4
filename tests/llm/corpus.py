"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node long, row string"


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    english = "the and of that with this from there which about people would could water under".split()
    german = "der und nicht mit einer auch werden durch wasser unter zwischen menschen schon über".split()
    out = []
    for i in range(n):
        lang, words = ("en", english) if i % 3 else ("de", german)
        text = " ".join(rng.choice(words) + rng.choice(["", "", "s", "en"]) for _ in range(rng.randint(6, 90)))
        out.append([i, text, lang, f"src{i % 4}"])
    out[5][1] = out[4][1]  # copies
    out[6][1] = out[4][1].replace(" ", "  ") + "\n"
    long = [rng.choice(english) + str(rng.randint(0, 99)) for _ in range(300)]
    near = list(long)
    near[150] = "changed"
    out[8][1], out[9][1] = " ".join(long), " ".join(near)
    out[10][1] = " ".join(near[:299] + ["else"])
    out[6][2] = out[9][2] = "en"
    passage = "this very passage is shared by several of the documents here, and it is longer than fifty bytes"
    for i in (20, 21, 22):
        out[i][1] = f"{out[i][1]} {passage} {out[i + 10][1]}"
    out[30][1], out[31][1], out[32][1], out[33][1] = None, "", "  \n ", "12 34 !!"
    out[34][1] = "ein einziges wort und ünïcödé ▁ ⬛ \t\x0b😀"
    out[35][1] = "x" * 5000 + " " + "über" * 900
    out[36][3], out[37][3], out[38][2] = None, None, None
    done = [tuple([*r, len(r[1]) if r[1] else 0, 7, 9, "clash"]) for r in out]
    done += [done[12], done[12], done[40]]  # repeated rows
    done += [(None, "a text without an id the and of", "en", "src1", 3, 1, 1, None), (None, None, None, None, None, None, None, None)]
    return done


def frame(spark, n: int = 60):
    return spark.createDataFrame(rows(n), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


COLUMNS = SCHEMA.replace(" long", "").replace(" string", "").split(", ")
