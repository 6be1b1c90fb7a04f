"""Stored pages after a crawl: what the query gives of the state that its operator makes."""

import json

from marketlens.plans import catalog
from tests.compare import compare, duck


def test_next_state_holds_keywords(spark, tmp_path):
    """Keywords of edited and new pages come from the new text, those of other pages from the stored one."""
    filler = " of the and by" * 10
    texts = {
        "edited": ("de", "Preise preise angebot" + filler),
        "new": ("es", "Precio precio oferta the THE the" + filler),
        "kept": ("en", "price offer Price étage price2 ab" + filler),
        "short": ("de", "kurz"),
        "wordless": ("fr", "12 34 -- ab " * 20),
        "long": ("en", " ".join(f"w{chr(97 + n)}x " * (15 - n) for n in range(14)) + filler),
        "copy": ("fr", "price offer Price étage price2 ab" + filler),
        "absent": ("en", None),
    }
    rows = [(n, text, lang, "src1", None if text is None else len(text)) for n, (lang, text) in enumerate(texts.values())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(
        str(tmp_path / "documents.parquet"))
    state = catalog.QUERIES["apply_content_changes"](spark, str(tmp_path))
    found = {r["url"].rsplit("/", 1)[1]: json.loads(r["keywords"]) for r in state.collect()}
    by_name = {name: found.get(str(n)) for n, name in enumerate(texts)}
    assert by_name == {
        "edited": ["preise", "angebot", "neu"], "new": ["precio", "oferta"], "kept": ["price", "offer"],
        "short": ["kurz"], "wordless": [], "long": [f"w{chr(97 + n)}x" for n in range(10)],
        "copy": ["price", "offer"], "absent": [],
    }
    shown = duck(str(tmp_path / "none"))
    shown.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    # A page without a text has no words in the Spark form and null words in the other.
    present = state.filter("text_content IS NOT NULL")
    assert compare(present, shown, f"SELECT * FROM ({catalog.ORACLES['apply_content_changes']}) WHERE text_content IS NOT NULL") is None
