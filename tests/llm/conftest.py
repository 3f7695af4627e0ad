import pytest

#: Columns beyond the table's own, with names that operators use inside.
EXTRA = "part int, pos string, fp string, label int, digest string, root string, own int"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows ``(doc_id, text[, lang[, source]])`` as a table of documents with clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), 1, "p", "f", 0, "d", "r", 0) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")

    return make


def prose(seed, n=60):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(("ba", "re", "ti", "on", "es", "la", "mo", "su")) for _ in range(r.randint(1, 4))) for _ in range(n))
