"""Queries over decks give all findings of their rules, or fail."""

import pytest
from pyspark.errors import AnalysisException

from decklake.operators import rules
from decklake.plans import decks


@pytest.fixture(scope="module")
def said(spark, tmp_path_factory):
    """Two conversations: of their titles one ends badly, one is too long, one is both, one neither."""
    path = str(tmp_path_factory.mktemp("said"))
    texts = [(0, 0, "user", "Ends."), (0, 1, "assistant", "One.\nTwo."), (0, 2, "user", "x" * 154), (7, 0, "user", "y" * 160 + ";"), (7, 1, "user", "z" * 153)]
    spark.createDataFrame(texts, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def test_a_rule_that_fails_gives_no_result(spark, said, monkeypatch):
    monkeypatch.setitem(rules.RULES, "bullet-punct", lambda x: rules.findings(x.decks.shapes.where("no_such_column"), "bullet-punct", rules.F.lit("")))
    with pytest.raises(AnalysisException) as error:
        decks.deck_summary(spark, said)
    assert any("bullet-punct" in n for n in error.value.__notes__)


def test_titles_are_judged_by_punctuation_and_length(spark, said):
    found = sorted(tuple(r) for r in decks.deck_title_findings(spark, said).collect())
    assert found == [(0, 1, "title-punct"), (0, 3, "title-lines"), (7, 1, "title-lines"), (7, 1, "title-punct")]
