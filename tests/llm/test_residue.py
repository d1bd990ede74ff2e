"""Problem 10: classifier, tree and both ways of propagation."""

from molquarry.llm import residue
from molquarry.llm.residue import TemplateTree, classify, tokens, unfilled


def _kind(text, n=1, short=1):
    return classify("\t".join(tokens(text)), n, short)


def test_messages_that_no_pattern_names():
    messages = (
        "Sorry, the requested video has been disabled.", "This profile isn't available.", "Diese Ansicht konnte nicht geladen werden.", "Please allow scripts and proceed.", "Headline goes here.",
        "Your session was locked.", "The link has expired.", "Access to this content was blocked.", "Insert title here.", "Une erreur inattendue est survenue.", "Ce fichier est introuvable.", "Su cuenta ha sido suspendida.",
    )
    found = [text for text in messages if _kind(text) != "content"]
    assert len(found) >= 0.8 * len(messages), set(messages) - set(found)
    for text in ("The sample was filtered and dried.", "The error of the fit is small.", "Die Probe wurde gewogen.", "We found the page of the notebook."):
        assert _kind(text) == "content", text


def test_context_overrules_words():
    assert _kind("This content isn't available right now.", 500, 500) == "error"
    assert _kind("This content isn't available right now.", 500, 3) == "content"  # it stands in running text


def test_long_sentences_are_judged_too():
    assert _kind("Internal server error " * 14) == "error" and _kind("text " * 60) == "filler"


def test_slots():
    assert all(unfilled(t) for t in ("Dear ~NAME~, hello", "Name: ________", "Value: ???", "For {{ name }} only"))
    assert not any(unfilled(t) for t in ("C~C~C", "what: is it?? no", "snake__case", "a ~ b ~ c"))


def test_tree_finds_what_a_scan_finds():
    import random

    rng = random.Random(5)
    tree, groups = TemplateTree(), []
    for _ in range(600):
        toks = [rng.choice("abcdef") for _ in range(7)]
        tree.add("7", list(toks), 1, 0)
        for g in groups:
            same = sum(a == b for a, b in zip(g[0], toks))
            if same >= residue.SIMILARITY * 7:
                g[0] = [a if a == b else residue.WILD for a, b in zip(g[0], toks)]
                g[1] += 1
                break
        else:
            groups.append([toks, 1])
    assert [(t, n) for _, t, n, _ in tree.rows()] == [("\t".join(t), n) for t, n in groups]


def test_both_ways_and_split_leaves_agree(spark, monkeypatch):
    texts = ["404 Not Found. Please try again later.", "Please try again later.", "The sample was filtered.", "The sample was filtered. 404 Not Found.", None, "", "  ", "Enable JavaScript to view this page. Try again.", "Name: ____"]
    texts += ["Go back to the start page. Our team has been informed."] * 3 + [f"Mixing acetone with lot {i} gave a clear solution in {i} min." for i in range(40)]
    df = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, path string")
    one = sorted(r[0] for r in residue.Residue(df).found.collect())
    monkeypatch.setattr(residue, "MOST_BROADCAST", 0)
    monkeypatch.setattr(residue, "LEAF_ROWS", 3)
    assert sorted(r[0] for r in residue.Residue(df).found.collect()) == one
    assert one == [0, 3, 4, 4, 5, 5]
    assert residue.Residue(df.limit(0)).found.count() == 0
