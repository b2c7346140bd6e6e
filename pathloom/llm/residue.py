"""Template residue, filler, error pages and script notices in place of a post.

Own lines are normalised and counted by host. Recurrent lines without evidence
are boilerplate and subtracted; a post is residue if an unfilled slot is left,
or if what is left is evidence rather than anything somebody wrote.
"""

from __future__ import annotations

import html
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .forum import own_words, slices

#: A line in at least this share of a host's posts, and in at least this many, is boilerplate.
RECURRENT, RECURRENT_POSTS = 0.05, 3
#: Most ordinary words left for one word of evidence.
ORDINARY_SHARE = 0.5

# Names that look like slots but are ordinary.
ENVIRONMENT = "APPDATA LOCALAPPDATA PROGRAMDATA PROGRAMFILES USERPROFILE USERNAME HOMEPATH HOMEDRIVE SYSTEMROOT SYSTEMDRIVE WINDIR PATH TEMP TMP COMSPEC COMPUTERNAME PUBLIC".split()
BRACKETED = "B I U S IMG URL QUOTE CODE LIST SIZE COLOR SPOILER EMAIL TABLE TR TD LI DELETED REMOVED ERROR WARN WARNING INFO DEBUG TRACE FATAL OK FAIL SOLVED OT PM FAQ EDIT UPDATE".split()
HTML_TAGS = ("a abbr address article aside audio b base big blockquote body br button canvas center cite code col dd del details dfn div dl dt em fieldset figure font footer "
             "form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol option p param pre q "
             "removed deleted s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr").split()
LOREM = set("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua sapien mauris turpis donec nunc felis orci "
            "rutrum sodales velit ligula porta vitae tempus arcu vestibulum quis nulla pellentesque fusce aenean vivamus".split())

_NAME = r"[A-Za-z][\w.]*"
#: Slot patterns by a text that each needs, so that posts without it skip them.
SLOTS = {need: re.compile(pattern) for need, pattern in {
    "{": r"\{\{[^{}\n]{0,60}\}\}|\{%[^{}\n]{1,60}%\}|[#$]\{ ?" + _NAME + r" ?\}|\{ ?\$?" + _NAME + r" ?\}",
    "<%": r"<%[^<>\n]{0,60}%>", "%%": r"%%" + _NAME + r"%%", "%": r"%(?!(?:" + "|".join(ENVIRONMENT) + r")%)[A-Z][A-Z_]{2,}%", "$": r"\$[A-Z][A-Z_]{2,}\$",
    "@@": r"@@" + _NAME + r"@@", "__": r"(?<!\w)__[A-Z][A-Z_]*[A-Z]__(?!\w)", "<<": r"<<[\w. ]{1,40}>>", "[[": r"\[\[" + _NAME + r"\]\]",
    "[": r"\[(?!(?:" + "|".join(BRACKETED) + r")\])[A-Z]{3,}(?:_[A-Z]+)*\]|\[insert [^\[\]\n]{1,40}\]|\[your [^\[\]\n]{1,30}\]|\[post body\]", "(your ": r"\(your [\w. ]{1,30} here\)",
    "<": r"<(?!(?:" + "|".join(HTML_TAGS) + r")>)[A-Za-z][A-Za-z_.]*(?: [A-Za-z_.]+){0,2}>",
}.items()}


def has_slot(text: str) -> bool:
    return any(need in text and pattern.search(text) for need, pattern in SLOTS.items())


_SCRIPT = r"(?:java ?script|\bjs\b|\bscripts?\b|\bscripting\b|\bskript\w*|скрипт\w*|\bactive content\b)"
_NOTICE = [
    rf"(?:please|kindly|to go on|you must|you need to)\b.*{_SCRIPT}", rf"(?:zum lesen )?bitte\b.*{_SCRIPT}", rf"(?:merci d|veuillez|il faut|vous devez)\b.*{_SCRIPT}",
    rf"(?:debe|por favor|para leer|active|habilite|permita)\b.*{_SCRIPT}", rf"(?:пожалуйста|чтобы|включите|разрешите)\b.*{_SCRIPT}",
    rf"(?:it (?:looks like|seems)|we noticed)\b.*{_SCRIPT}", rf"{_SCRIPT} (?:is |are |has been |must be )?(?:disabled|required|off|blocked|needed|turned off|enabled)\b",
    r"your browser does not support", rf"(?:this|ce|este|diese[rs]?) (?:board|site|website|page|forum|sitio|foro|seite)\b.*{_SCRIPT}", r"checking your browser", rf"we use {_SCRIPT}",
]
_STATUS = r"(?:bad gateway|bad request|conflict|forbidden|gateway timeout|gone|internal server error|method not allowed|not found|request timeout|service unavailable|too many requests|unauthorized)"
_ERROR = [
    rf"(?:http(?:/\d\.\d)? )?(?:error )?[45]\d\d\b[: -]*{_STATUS}?\W*$", rf"{_STATUS}\W*$", r"error [45]\d\d\W*$", rf"error:? {_STATUS}",
    r"(?:error|erreur|fehler|fallo|aviso|ошибка|сбой|störung|wartung|maintenance|incident|panne|mantenimiento|hinweis) ?\d* ?: .{3,70}$",
    r"(?:\w+-)?e(?:rr|rror)?_[a-z]+(?:_[a-z]+)*(?: \d+)?\W*$", r"(?:fatal error|parse error|warning|notice|unhandled exception) ?:.*(?:\bin \S+:\d+|\bon line \d+)",
    r"\w+ (?:error|exception|fault)\W*[\[(#]?\w*\d\w*[\])]?\W*: ?\S", r"traceback \(most recent", r"file \".*\", line \d+", r"\w*(?:error|exception): \S",
    r"(?:the|this|that)(?: requested)? (?:page|topic|post|board|thread|forum) (?:could not be|cannot be|does not exist|no longer exists|has been taken offline|has been moved|failed to load|is not available|is unavailable)",
    r"the page you are looking for", r"the (?:\w+ ){1,3}(?:is overloaded|refused the connection|timed out|did not answer|is down)(?: (?:after \d+ ?s|\(code \d+\)))?\W*$",
    r"the server reported code \d+", r"(?:sorry|oops)\W+something went wrong", r"you do not have permission", r"your session has expired", r"too many connections", r"access denied",
    r"zugriff verweigert", r"die angeforderte seite", r"la page demandée", r"accès refusé", r"acceso denegado", r"доступ запрещ", r"no se encontró la página", r"страница не найдена",
    r"внутренняя ошибка", r"une erreur interne", r"error interno", r"interner (?:server)?fehler",
]
_CHROME = [
    r"back to the (?:start|home) ?page", r"reference #\w+", r"request id \w+", r"loading\b", r"\w+ server\W*$", r"\[?reload\]?\W*$", r"if the problem persists", r"please (?:log|sign) in", r"bitte melden sie sich",
    r"(?:please )?try again", r"inténtelo", r"réessayez", r"versuchen sie", r"попробуйте", r"switch it on", r"allow them", r"please wait", r"contact the", r"(?:oops|sorry|uh oh|whoops|hmm)\W*$", r"at \S+:\d+",
]
_FILLER = [
    r"todo: write [a-z]+?(?=todo|\b)", r"(?:title|your \w+|text|content) goes here", r"add some \w+ here", r"this is placeholder \w+", r"replace it before \w+", r"dummy post(?:, ignore)?", r"blindtext(?:, bitte ersetzen)?",
    r"hier steht später der eigentliche text", r"texte à venir", r"aquí va el contenido del mensaje", r"здесь будет текст", r"placeholder text", r"insert text here",
]
# Every statement that one of the three pattern lists matches holds one of these.
HINTS = ("script js skript скрипт active browser error err_ e_ exception erreur fehler fallo aviso ошибка ошибк сбой störung wartung maintenance incident panne mantenimiento hinweis warning notice traceback "
         "page topic post board thread forum overloaded refused timed answer down reported went permission session connections denied verweigert seite demandée refusé denegado запрещ página страница "
         "interne interno interner reference request loading server reload persists log sign melden again inténtelo réessayez versuchen попробуйте switch allow wait contact oops sorry uh whoops hmm "
         "gateway conflict forbidden gone found unavailable unauthorized not method at file back").split()
NOTICE, ERROR, CHROME = (re.compile(r"(?:notice: |hinweis: )?(?:" + "|".join(p) + ")", re.I) for p in (_NOTICE, _ERROR, _CHROME))
FILLER = re.compile(r"(?:" + "|".join(_FILLER) + r")[.!…]*", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|\[/?(?:b|i|u|s|img|url|size|color|list|quote|code)\b[^\[\]]*\]", re.I)
_WORD = re.compile(r"[^\W_]+")
#: A word nobody can say: no vowel, or four consonants in a row.
_MASHED = re.compile(r"[b-df-hj-np-tv-xz]+|[a-z]*[b-df-hj-np-tv-xz]{4}[a-z]*")
#: Words of the left hand and the home row alone.
_KEYS = re.compile(r"[adefghjklqrstwz]+")
_FILLER_HINTS = ("todo", "goes here", "add some", "placeholder", "replace it", "dummy", "blindtext", "hier steht", "texte à", "aquí va", "здесь", "insert")
_DIGITS = re.compile(r"\d+")
_TRACE = re.compile(r"\b(?:reference|request id) #?[0-9a-f]+\b", re.I)
_STARTS_WITH_CODE = re.compile(r"(?:http|[45]\d\d\b|bad |too many)")
_STATEMENT = re.compile(r"\n+|(?<=[.!?…])\s+")


class _Mashed(dict):
    """Word -> whether nobody can say it; looked up, as words recur."""

    def __missing__(self, word: str) -> bool:
        found = bool(_MASHED.fullmatch(word))
        if len(self) < 200_000:
            self[word] = found
        return found


_MASHED_WORDS = _Mashed()


def _empty_words(words: list[str]) -> bool:
    """One or two words over and over, or keys struck at random."""
    if len(words) < 3:
        return False
    kinds = len(set(words))
    if kinds == 1 or (len(words) >= 6 and kinds == 2):
        return True
    mashed = sum(map(_MASHED_WORDS.__getitem__, words))
    return mashed >= 0.6 * len(words) or (len(words) >= 5 and mashed > 0 and all(_KEYS.fullmatch(w) for w in words))


def _hinted():
    """Whether a lower-case text holds one of :data:`HINTS`, in one pass."""
    try:
        import ahocorasick
    except ImportError:
        return re.compile("|".join(HINTS)).search
    automaton = ahocorasick.Automaton()
    for hint in HINTS:
        automaton.add_word(hint, 1)
    automaton.make_automaton()
    return lambda text: next(automaton.iter(text), None)


_HAS_HINT: list = []


def hinted(text: str) -> bool:
    if not _HAS_HINT:
        _HAS_HINT.append(_hinted())
    return _HAS_HINT[0](text) is not None or _STARTS_WITH_CODE.match(text) is not None


def judge(statement: str) -> tuple[str, int]:
    """Kind of a statement (error, notice, filler, chrome, ordinary) and its number of words."""
    low = statement.lower()
    words = _WORD.findall(low)
    if not words:
        return "chrome", 0
    if len(words) >= 4 and words[0] in LOREM | {"and"} and sum(w in LOREM for w in words) >= 0.8 * len(words):
        return "filler", len(words)
    if _empty_words(words):
        return "filler", len(words)
    if hinted(low):
        for kind, pattern in (("notice", NOTICE), ("error", ERROR), ("chrome", CHROME)):
            if pattern.match(statement):
                return kind, len(words)
    return "ordinary", len(words)


def dissect(text: str | None) -> list[tuple[int | None, str, int]]:
    """(hash of the normalised line, kind, words) of a post's own words; kind ``slot`` for an unfilled template slot. Only ordinary lines have a hash."""
    if not text:
        return []
    own = html.unescape(own_words(text))
    out = [(None, "slot", 1)] if has_slot(own) else []
    plain = _TAG.sub("\n", own)
    low = plain.lower()
    filler = sum(len(_WORD.findall(m)) for m in FILLER.findall(plain)) if any(h in low for h in _FILLER_HINTS) else 0
    if filler:
        out.append((None, "filler", filler))
        plain = FILLER.sub("\n", plain)
    if "reference" in low or "request" in low:
        plain = _TRACE.sub("\n", plain)
    words = _WORD.findall(plain.lower())
    if _empty_words(words):
        return [*out, (None, "filler", len(words))]
    for statement in _STATEMENT.split(plain):
        statement = " ".join(statement.split())
        if statement:
            kind, words = judge(statement)
            out.append((xxhash.xxh3_64_intdigest(_DIGITS.sub("0", statement.lower())) - (1 << 63) if kind == "ordinary" else None, kind, words))
    return out


_LINES = "doc_id long, host string, lines array<struct<line: bigint, kind: string, words: int>>"


def _dissect(batches):
    for pdf in batches:
        for rows in slices(pdf["text"].array):
            lines = [[{"line": a, "kind": k, "words": n} for a, k, n in dissect(t)] for t in pdf["text"].iloc[rows]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[rows], "host": pdf["host"].iloc[rows], "lines": lines})


EVIDENCE = ("slot", "error", "notice", "filler")


def residue(documents: DataFrame, host: str = "source", recurrent: float = RECURRENT, least: int = RECURRENT_POSTS) -> DataFrame:
    """(doc_id, kind) of posts that are template residue, filler, an error page or a script notice.

    kind: ``slot`` for an unfilled slot anywhere in the own words, else the
    evidence with most words. Null, empty and blanked posts have no own words
    and are no cases. A null host is a host of its own. Rows with a null doc_id
    cannot be named and are left out; a repeated row gives its result once.
    A line is boilerplate in at least ``recurrent`` of a host's distinct posts,
    and in ``least`` of them, so the rule is the same for hosts of every size.

    Only ordinary lines of posts with evidence are matched against the counts,
    so the bulk of the corpus is read and counted but never joined. Lines are
    known by a 64-bit hash. Rows are counted first, which combines before the
    shuffle; only of lines that then may recur are distinct posts counted.
    """
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", F.coalesce(host, F.lit("")).alias("host"), "text")
    posts = materialize(texts.mapInPandas(_dissect, _LINES), "dissected")
    mine = F.array_distinct(F.transform(F.filter("lines", lambda x: x["kind"] == "ordinary"), lambda x: x["line"]))
    line = posts.select("doc_id", "host", F.explode(mine).alias("line"))
    sizes = posts.groupBy("host").agg(F.count_distinct("doc_id").alias("of"))
    often = line.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least).join(sizes, "host").where(F.col("n") >= F.col("of") * recurrent)
    seen = line.join(often.select("host", "line", "of"), ["host", "line"]).groupBy("host", "line", "of").agg(F.count_distinct("doc_id").alias("n"))
    boilerplate = seen.where((F.col("n") >= least) & (F.col("n") >= F.col("of") * recurrent)).select("host", "line", F.lit(True).alias("common"))
    suspect = posts.where(F.exists("lines", lambda x: x["kind"].isin(*EVIDENCE))).select("doc_id", "host", F.explode("lines").alias("l")).select("doc_id", "host", "l.*")
    matched = suspect.where("kind = 'ordinary'").join(boilerplate, ["host", "line"], "left")
    judged = matched.unionByName(suspect.where("kind != 'ordinary'").withColumn("common", F.lit(None).cast("boolean")))
    words = F.col("words")

    def total(kind: str):
        return F.sum(F.when(F.col("kind") == kind, words).otherwise(0)).alias(kind)

    left = F.sum(F.when((F.col("kind") == "ordinary") & F.col("common").isNull(), words).otherwise(0)).alias("ordinary")
    per_post = judged.groupBy("doc_id").agg(*[total(k) for k in EVIDENCE], left)
    weight = F.col("error") + F.col("notice") + F.col("filler")
    case = (F.col("slot") > 0) | ((weight > 0) & (F.col("ordinary") <= weight * ORDINARY_SHARE))
    top = F.greatest("error", "notice", "filler")
    kind = F.when(F.col("slot") > 0, "slot").when(F.col("error") == top, "error").when(F.col("notice") == top, "notice").otherwise("filler")
    return per_post.where(case).select("doc_id", kind.alias("kind"))


def clean(documents: DataFrame) -> DataFrame:
    """``documents`` without its residue; all columns as they were. Rows with a null doc_id stay."""
    return documents.join(residue(documents).select("doc_id"), "doc_id", "left_anti")
