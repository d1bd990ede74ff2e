"""Problem 10: template residue and error-page text.

Sentences of all documents are mined for message templates with a fixed-depth prefix tree (length, then
leading tokens, then token similarity). Each template is classified once, by a classifier of its words
together with where the corpus has it (in texts of a few sentences, or in running text), and verdicts are
propagated to documents: one without any sentence of real content, but with residue, is a case. Slots
left unfilled within ordinary sentences are detected separately.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.llm.messages import MOST_SAMPLE, Messages
from molquarry.session import materialise, parallelism, spread

#: Leading tokens that the tree branches on, and the share of equal tokens that joins a template.
DEPTH = 2
SIMILARITY = 0.7
#: A leading token that is rarer than this share of all sentences takes the wildcard branch, so that a
#: level of the tree has at most 1 / RARE branches.
RARE = 1e-4
#: Templates of residue or furniture beyond this are joined by shuffle instead of broadcast.
MOST_BROADCAST = 200_000
#: A text of up to this many sentences is short; a message stands in short texts, content mostly in others.
SHORT = 4
#: Different sentences of one leaf beyond which it is split by a MinHash of their tokens, as similar ones share it.
LEAF_ROWS = 2_000

WILD = "<*>"

# Words of the customary Latin filler text.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna "
    "aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa "
    "qui officia deserunt mollit anim id est laborum pellentesque vitae lectus ornare augue risus mauris donec vestibulum faucibus "
    "curabitur phasellus vivamus integer nunc praesent suspendisse maecenas quisque aenean".split()
)

_SENTENCE = re.compile(r"[\r\n]+|(?<=[.!?…])\s+|(?<=[。！？])")
_BULLET = re.compile(r"^(?:[-*•#>]+|\d{1,3}[.)])\s+")
_ITEM = re.compile(r"^\d{1,3}[.)]$")
_DIGITS = re.compile(r"\d+")
_STRUCTURE = re.compile(r"^(?=\S*[()=\[\]#])(?=\S*[cnoCNO])[A-Za-z0-9@+\-\[\]()=#%./\\]{8,}$")
_HEADING = re.compile(r"^(?:#{1,6}\s+)?[^\W\d_][^.:!?;,=\t|\[\]{}<>]*$")


def sentences(text: str) -> list[str]:
    """Sentences and lines; numbers of list items on their own are left out."""
    return [s for s in (x.strip() for x in _SENTENCE.split(text)) if s and not _ITEM.match(s)]


def tokens(sentence: str) -> list[str]:
    """Lower-case tokens with numbers as 0, structures as one mark, and runs of filler as one mark."""
    out: list[str] = []
    latin = 0
    raw = _BULLET.sub("", sentence).split()
    words = [w.strip(".,;:!?").lower() for w in raw]
    filler = sum(w in LATIN for w in words) >= max(2, 0.6 * len(words)) or (len(words) < 3 and all(w in LATIN for w in words))
    for r, w in zip(raw, words):
        if filler and w in LATIN:
            latin += 1
            if out[-1:] != ["<latin>"]:
                out.append("<latin>")
            continue
        out.append("<structure>" if _STRUCTURE.match(r) else _DIGITS.sub("0", r.lower()))
    return out


def leaf(toks: list[str], common: frozenset | set) -> str:
    """Path to a leaf of the tree: number of tokens and leading tokens, rare ones and numbers as wildcard."""
    lead = [t if t in common and "0" not in t else WILD for t in toks[:DEPTH]]
    return "\t".join([str(len(toks)), *lead])


class TemplateTree:
    """Templates of each leaf, as token lists with wildcards, and how many sentences each stands for.

    A sentence joins the first template that shares SIMILARITY of its tokens. As fewer than a share of
    1 - SIMILARITY of places then differ, one of as many blocks of places and one more is wholly equal:
    templates are looked up by blocks, so that a leaf isn't scanned.
    """

    def __init__(self) -> None:
        self.leaves: dict[str, list[list]] = {}
        self.blocks: dict[tuple, list[int]] = {}

    def add(self, path: str, toks: list[str], n: int, short: int = 0) -> None:
        group, size = self.leaves.setdefault(path, []), len(toks)
        parts = size - math.ceil(SIMILARITY * size - 1e-9) + 1
        cuts = [(size * i // parts, size * (i + 1) // parts) for i in range(parts)]
        keys = [(path, i, *toks[a:b]) for i, (a, b) in enumerate(cuts)]
        for at in sorted({x for k in keys for x in self.blocks.get(k, ())}):
            t = group[at]
            same = sum(a == b for a, b in zip(t[0], toks))
            if same >= SIMILARITY * size:
                if same < size:
                    t[0] = [a if a == b else WILD for a, b in zip(t[0], toks)]
                t[1] += n
                t[2] += short
                return
        for k in keys:
            self.blocks.setdefault(k, []).append(len(group))
        group.append([toks, n, short])

    def rows(self) -> Iterator[tuple[str, str, int, int]]:
        for path, group in self.leaves.items():
            for toks, n, short in group:
                yield path, "\t".join(toks), n, short


# Phrases of messages. NP stands for what a message is about.
_NP = r"(?:[\w<>*-]+ ){0,4}[\w<>*-]+"
_PHRASES = {
    "error": [
        r"error 0:.*no existe", r"erreur 0 ?:.*introuvable", r"页面不存在.*", rf"(?:the )?(?:requested )?{_NP} (?:does not|doesn't) exist on this server",
        r"access denied", rf"you (?:do not|don't) have permission to {_NP}", rf"you lack the rights to open {_NP}", r"your session has expired", rf"please sign in again(?: to see {_NP})?",
        r"too many requests", r"slow down and retry(?: in 0 seconds)?", r"bad gateway", r"gateway timeout(?:: upstream took longer than 0 s to answer)?", r"service (?:is )?(?:temporarily )?unavailable(?: \(code 0\))?",
        r"le service est momentanément indisponible", r"el servicio no está disponible en este momento", r"die seite .*(?:nicht erreichbar|nicht gefunden).*", r"diese seite konnte nicht gefunden werden.*", r"internal server error", r"interner serverfehler",
        r"bitte versuchen sie es später erneut", r"the server could not complete your request", rf"our server ran into trouble while {_NP}", rf"an unhandled exception occurred in {_NP}", rf"fatal error: {_NP}.*",
        r"error establishing a database connection", r"traceback \(most recent call last\).*", r"^file [\"<].*, line 0, in .*", r"^\w*(?:error|exception): .*", r"^row = .*", rf"something went wrong while {_NP}", r"our team has been informed",
        rf"we (?:can't|cannot|can’t) find the page you are looking for", r"it may have been moved or deleted", rf"this {_NP} (?:has been|was) (?:moved|withdrawn|deleted)(?: or \w+)?", rf"this {_NP} is no longer available", rf"\bno {_NP} matches this address",
        rf"(?:the )?{_NP} service did not answer in time", rf"the connection to {_NP} was refused", rf"the {_NP} you asked for could not be \S+", rf"rendering of {_NP} failed", r"unable to load page", r"record unavailable",
        r"verify that you are human(?: to continue)?", r"checking your connection", r"^(?:oops|whoops|sorry)\b", r"0 - request failed", r"\b0 (?:not found|forbidden|bad gateway)", r"^not found\b", r"^forbidden\b",
        r"(?:http |error |erreur |fehler |status:? |problem |code )+0\b", r"^0$", r"^0 (?=[^\W\d_]{2,})",
    ],
    "script": [
        rf"(?:please )?(?:enable|activate|turn on|switch on) (?:java)?scripts?(?: to {_NP})?", r"you need to enable javascript.*", r"javascript is (?:disabled|blocked|turned off|required)(?: in your browser)?", rf"(?:requires|needs|relies on|does not run without) (?:javascript|client-side scripting|scripts|scripting)(?: to work)?",
        r"some features of this site will not work", r"requires a browser with scripts enabled", r"cannot be shown while scripts are turned off", r"stays empty until scripting is allowed", r"we noticed that your script blocker is active",
        rf"your browser does not support (?:java)?script(?:ing|s)?(?:, which is needed to {_NP})?", rf"scripts are (?:blocked|disabled|turned off)(?:: {_NP})?", r"<noscript>.*", r"loading viewer\.*", r"if nothing appears", r"allow scripts and cookies(?: for this site|, then retry)?",
        r"turn it on in your browser(?: and reload the page)?", r"switch it on and reload", r"then refresh this window", r"change your browser settings", rf"veuillez activer javascript.*", r"active javascript para.*", r"bitte aktivieren sie javascript.*", r"请启用.*javascript.*", r"this page works only with scripts.*",
    ],
    "filler": [
        r"<latin>", r"placeholder text(?: for [\w ]+)?", r"sample text goes here", rf"replace this paragraph with {_NP}", r"this is dummy text", r"it will be replaced by [\w ]+", r"your content will appear in this space", rf"add a short description of {_NP}",
        rf"type your {_NP} here", r"click to add \S+", r"texto de relleno", r"aquí irá [\w ]+", r"texte provisoire", r"le contenu sera ajouté[\w ]*", r"blindtext.*", r"此处填写.*", r"示例文字.*", r"\bx{3,}\b", r"\b(?:asdf|jkl|qwerty)\b", r"(?:\b(?:text|test|0)\b ?){3,}",
    ],
    "furniture": [
        r"please (?:reload|refresh) the page", r"try again later", r"(?:please )?try again", r"(?:go )?back to (?:the )?start page", r"return to the search page", r"contact the administrator and quote id 0", r"request id: \S+", r"reference #\S+", r"check the address and repeat your search",
        r"^home \|.*", r"^search › .*", r"powered by .*", r"cookies are used on this site", r"^imprint privacy contact$", r"^© .*", r"^(?:menu|browse|upload|about|help|login|search)$",
    ],
}
_CUES = {k: re.compile("|".join(f"(?:{p})" for p in v)) for k, v in _PHRASES.items()}
#: A message that is quoted or told about within a sentence of its own.
_TOLD = re.compile(r"""['"”’»]\s*(?:,|or\b|in\b|on\b|and\b|which\b|as\b|while\b)|<structure>|\b(?:which is why|were thrown out|is what|cost us|caused by|in place of)\b""")


_TRACE = re.compile(r"""^(?:traceback \(|file ["<][^"<>]+[">]?, line 0, in )""")


def pattern_label(template: str) -> str:
    """error, script, filler, furniture or content, by the share of a template that the patterns explain."""
    text = template.replace("\t", " ").strip().strip("'\"“”‘’")
    if _TOLD.search(text) and not _TRACE.match(text):
        return "content"
    words = max(len(text.split()), 1)
    best, kind = 0.0, "content"
    covered = text
    for k, rx in _CUES.items():
        n = sum(max(len(m.group(0).split()), 1) for m in rx.finditer(text))
        if n / words > best:
            best, kind = n / words, k
        covered = rx.sub(" ", covered)
    left = len([w for w in covered.split() if re.search(r"\w", w)])
    # messages may run together ("not found" and what failed), so that together they must explain it
    return kind if left <= 0.55 * words and best > 0 else "content"


#: Log-odds that the classifier needs on its own, and that context in the corpus can add or take.
LEAST_ODDS = 1.5
MOST_CONTEXT = 3.0


def fitted(sample: list[tuple[str, int, int]]) -> Messages:
    """The classifier, from a bounded sample of templates (template, sentences, of these in short texts).

    Templates that patterns explain have their label; of the others, those mostly in running text are content.
    """
    labelled = []
    for template, n, short in sample[:MOST_SAMPLE]:
        kind = pattern_label(template)
        if kind != "content" or short < 0.5 * n:
            labelled.append((template.split("\t"), kind))
    return Messages(labelled)


def classify(template: str, n: int = 1, short: int = 1, model: Messages | None = None) -> str:
    """error, script, filler, furniture or content.

    The evidence is added up: the classifier's log-odds, whether patterns explain the template, and the
    corpus: how many of its ``n`` sentences stand in short texts. A message told about is content.
    """
    text = template.replace("\t", " ").strip().strip("'\"“”‘’")
    if _TOLD.search(text) and not _TRACE.match(text):
        return "content"
    label = pattern_label(template)
    kind, odds, known = (model or _PLAIN).odds(template.split("\t"))
    # one sentence says nothing about where a template stands, many do
    context = max(-MOST_CONTEXT, min(MOST_CONTEXT, math.log((short + 0.5) / (n - short + 0.5)))) * min(1.0, (n - 1) / 10)
    if label != "content":
        return label if odds + context > -2 * MOST_CONTEXT else "content"
    return kind if known >= 0.5 and odds > LEAST_ODDS and odds + context > LEAST_ODDS and short >= 0.5 * n else "content"


_PLAIN = Messages([])


# Slots left unfilled, in any letter case; brackets of structures and marks of HTML are no slots.
_NAME = r"[a-z][a-z0-9]*(?:[ _][a-z0-9]+){0,3}"
_HTML = r"(?!/?(?:a|b|i|p|br|hr|em|li|ol|ul|td|th|tr|div|img|pre|span|code|html|head|body|table|script|noscript|strong|h[1-6])\b)"
SLOT = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\$\{{\s*{_NAME}\s*\}}|\$\({_NAME}\)|\{{%\s*{_NAME}\s*%\}}|<%=?\s*{_NAME}\s*%>|\[\[\s*{_NAME}\s*\]\]|<<\s*{_NAME}\s*>>|@@{_NAME}@@|%\({_NAME}\)[sd]"
    rf"|(?<![\w~])~{_NAME}~(?![\w~])|(?:^|(?<=[\s|]))[^\W\d_][\w ]{{0,30}}: *(?:_{{3,}}|\?{{2,}})(?=\s|[.;,|]|$)|__{_NAME}__|(?<![\w%])%{_NAME}%(?!\w)|(?<!\w)#[a-z][a-z0-9]*(?:_[a-z0-9]+){{0,3}}#(?!\w)|&lt;\s*{_NAME}\s*&gt;|<{_HTML}{_NAME}>|(?<![\w$%\"'{{])\{{{_NAME}\}}"
    rf"|\[(?:tbd|todo|insert|enter|fill in|your)\b[^\[\]\n]{{0,60}}\]|\((?:enter|insert|fill in) {_NAME}\)|\bxx+\.xx+\b|(?<![\w()\[\]=#+@/\\%.])\[(?=[a-z ]{{3,}}\])(?!sic\]){_NAME}\](?![\w(\[])",
    re.IGNORECASE | re.MULTILINE,
)
#: A sentence that explains how slots are filled.
_EXPLAINS = re.compile(
    r"\btemplates?\b|\bplaceholders?\b|stands? for\b.*\b(?:replaced|name)|\brenderer\b|\bis replaced\b|\bare replaced\b|\bare resolved\b|\bis resolved\b|where the value goes|\bis built with\b|\bis filled with\b|\bformat\b.*\bstring\b|\bvariables?\b|\bwe set \S+ to\b",
    re.IGNORECASE,
)


def unfilled(text: str) -> bool:
    """Whether a slot stands where a value belongs, in a sentence that doesn't explain slots."""
    if SLOT.search(text) is None:
        return False
    return any(SLOT.search(s) and not _EXPLAINS.search(s) for s in re.split(r"[\r\n]+|(?<=[.!?…])\s+(?=[^\W\d_a-z]|[\W\d_])|(?<=[。！？])", text))


class Residue:
    """``templates``: (path, template, n, verdict) of all sentences; ``found``: the cases.

    A document is a case if a slot is unfilled, or if it has a sentence of error page, script notice or
    filler and none of content; page furniture and headings count for neither. Null, empty and blank
    texts are no cases. Whole texts are read; repeated rows are judged alike; other columns aren't read;
    an empty table gives an empty result.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length(F.trim("text")) > 0)
        self.kind = dict(docs.dtypes)[id_col]
        self.sentences = self._distinct()
        self.common = self._leading()
        self.templates = self._mine()
        self.found = self._propagate()

    def _distinct(self) -> DataFrame:
        """(sentence, n, short): different token rows of all texts, the one pass that reads texts for mining."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                n: Counter = Counter()
                few: Counter = Counter()
                for t in pdf["text"]:
                    own = [toks for s in sentences(t) if (toks := tokens(s))]
                    own = ["\t".join(toks) for toks in own]
                    n.update(own)
                    if len(own) <= SHORT:
                        few.update(own)
                yield pd.DataFrame({"sentence": list(n), "n": list(n.values()), "short": [few[s] for s in n]})

        found = spread(self.docs).mapInPandas(run, "sentence string, n long, short long")
        return materialise(found.groupBy("sentence").agg(F.sum("n").alias("n"), F.sum("short").alias("short")), "residue-sentences")

    def _leading(self) -> frozenset:
        """Leading tokens frequent enough for a branch; at most DEPTH / RARE of them."""
        lead = F.explode(F.array_distinct(F.slice(F.split("sentence", "\t"), 1, DEPTH))).alias("token")
        total = self.sentences.agg(F.sum("n")).first()[0] or 0
        counts = self.sentences.select(lead, "n").groupBy("token").agg(F.sum("n").alias("n"))
        return frozenset(r["token"] for r in counts.filter(F.col("n") >= max(2, total * RARE)).select("token").collect())

    def _mine(self) -> DataFrame:
        common = self.common

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf["path"] = [leaf(s.split("\t"), common) for s in pdf["sentence"]]
                yield pdf

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree, at = TemplateTree(), None
            for pdf in batches:
                for branch, path, sentence, n, short in zip(pdf["branch"], pdf["path"], pdf["sentence"], pdf["n"], pdf["short"]):
                    if (path, branch) != at:  # leaves come one after the other; only one is held
                        if at is not None:
                            yield pd.DataFrame(list(tree.rows()), columns=["path", "template", "n", "short"])
                        tree, at = TemplateTree(), (path, branch)
                    tree.add(path, sentence.split("\t"), int(n), int(short))
            if at is not None:
                yield pd.DataFrame(list(tree.rows()), columns=["path", "template", "n", "short"])

        rows = materialise(self.sentences.mapInPandas(placed, "sentence string, n long, short long, path string"), "residue-placed")
        hot = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > LEAF_ROWS)  # at most rows / LEAF_ROWS
        low = F.array_min(F.transform(F.split("sentence", "\t"), lambda t: F.xxhash64(t)))
        branch = F.when(F.col("size").isNotNull(), F.pmod(low, F.ceil(F.col("size") / F.lit(LEAF_ROWS)))).otherwise(F.lit(0)).cast("long")
        branched = rows.join(hot, "path", "left").withColumn("branch", branch).drop("size")
        # a fixed number of partitions, as few bytes of sentences are much work
        ordered = branched.repartition(parallelism(branched.sparkSession) * 4, "path", "branch").sortWithinPartitions("path", "branch", "sentence")
        mined = materialise(ordered.mapInPandas(merge, "path string, template string, n long, short long"), "residue-mined")
        sample = mined.select("template", "n", "short").orderBy(F.xxhash64("template")).limit(MOST_SAMPLE).collect()
        model = self.docs.sparkSession.sparkContext.broadcast(fitted([tuple(r) for r in sample]))

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf["verdict"] = [classify(t, n, short, model.value) for t, n, short in zip(pdf["template"], pdf["n"], pdf["short"])]
                yield pdf

        return materialise(mined.mapInPandas(judge, "path string, template string, n long, short long, verdict string"), "residue-templates")

    def _propagate(self) -> DataFrame:
        common, messages = self.common, self.templates.filter("verdict != 'content'")
        if messages.count() > MOST_BROADCAST:
            return self._propagate_by_join(messages)
        table: dict[str, list[tuple[list[str], str]]] = {}
        for r in messages.select("path", "template", "verdict").collect():
            table.setdefault(r["path"], []).append((r["template"].split("\t"), r["verdict"]))
        shared = self.docs.sparkSession.sparkContext.broadcast({p: sorted(x, key=lambda m: SEVERITY.index(m[1])) for p, x in table.items()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = shared.value
            for pdf in batches:
                yield pdf.loc[[verdict(t, known, common) for t in pdf["text"]], ["doc_id"]]

        return spread(self.docs).mapInPandas(run, f"doc_id {self.kind}")

    def _propagate_by_join(self, messages: DataFrame) -> DataFrame:
        """The same without a broadcast: sentences meet templates by path, verdicts return by text."""
        common = self.common

        def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for h, t in zip(pdf["text_id"], pdf["text"]):
                    slot = unfilled(t)
                    for s in sentences(t):
                        toks = tokens(s)
                        out.append((h, slot, leaf(toks, common), "\t".join(toks), is_heading(s)))
                yield pd.DataFrame(out, columns=["text_id", "slot", "path", "sentence", "heading"])

        @F.pandas_udf("boolean")
        def fits(s: pd.Series, t: pd.Series) -> pd.Series:
            return pd.Series([matches(a.split("\t"), b.split("\t")) for a, b in zip(s, t)])

        # equal texts are judged once, and every row that has such a text comes out
        docs = self.docs.withColumn("text_id", F.struct(F.xxhash64("text"), F.hash("text"), F.length("text")).cast("string"))
        u = spread(docs.select("text_id", "text")).mapInPandas(units, "text_id string, slot boolean, path string, sentence string, heading boolean")
        one = u.select("path", "sentence").distinct().join(messages.select("path", "template", "verdict"), "path").filter(fits("sentence", "template"))
        rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("verdict"))
        verdicts = one.groupBy("path", "sentence").agg(F.min_by("verdict", rank).alias("verdict"))
        v = u.join(verdicts, ["path", "sentence"], "left")
        real = F.col("verdict").isNull() & ~F.col("heading")
        bad = F.col("verdict").isin("error", "script", "filler")
        per = v.groupBy("text_id").agg(F.max("slot").alias("slot"), F.max(real).alias("real"), F.max(F.coalesce(bad, F.lit(False))).alias("bad"))
        return docs.join(per.filter("slot or (bad and not real)").select("text_id"), "text_id", "left_semi").select("doc_id")


#: Where a sentence fits several templates, the first of these decides.
SEVERITY = ("error", "script", "filler", "furniture")


def is_heading(sentence: str) -> bool:
    return len(sentence) <= 60 and len(sentence.split()) <= 5 and _HEADING.match(sentence) is not None


def matches(toks: list[str], template: list[str]) -> bool:
    return len(toks) == len(template) and all(b == WILD or a == b for a, b in zip(toks, template))


def verdict(text: str, known: dict[str, list[tuple[list[str], str]]], common: frozenset) -> bool:
    """Whether a document is a case, by the verdicts of its sentences' templates."""
    if unfilled(text):
        return True
    bad = False
    for s in sentences(text):
        toks = tokens(s)
        kind = next((k for t, k in known.get(leaf(toks, common), ()) if matches(toks, t)), None)
        if kind is None:
            if not is_heading(s):
                return False
        elif kind != "furniture":
            bad = True
    return bad
