"""Small tables with the awkward rows every operator must take."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long, node long, score string, bucket int"


def texts() -> dict[int, str | None]:
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choices(words, k=60) for _ in range(12)]
    found: dict[int, str | None] = {}
    for i, w in enumerate(base):
        found[10 * i] = " ".join(w)
        found[10 * i + 1] = "\n".join(w).upper()  # the same shingles
        changed = list(w)
        changed[draw.randrange(60)] = "other"
        found[10 * i + 2] = " ".join(changed)
        changed[draw.randrange(60)] = "another"
        found[10 * i + 3] = " ".join(changed)
    found |= {900: None, 901: "", 902: " \n\t", 903: "one two", 904: "ONE  two", 905: "é ü " * 30}
    found[906] = " ".join(draw.choices(words, k=30_000))
    found[907] = found[906] + " more"
    return found


def documents(spark, rows: dict | None = None):
    """Extra columns carry names that operators use inside."""
    rows = texts() if rows is None else rows
    data = [(i, t, "en", "s", len(t or ""), 7, "x", 1) for i, t in rows.items()]
    return spark.createDataFrame(data, KINDS)


def table(name: str) -> list[dict]:
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def arrow(values) -> pa.Array:
    return pa.array(values, pa.string())
