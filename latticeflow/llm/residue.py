"""Template residue, filler and error-page text: message templates mined in a fixed-depth prefix tree, and unresolved slots.

The lines and sentences of a document, as a page would show them and without code and quotations, are its messages. Messages that
hold a cue of a general vocabulary (words that pages use about themselves, not whole phrases) hang in a tree of fixed depth: number of
tokens, then the first tokens. Within a leaf, a place that several otherwise equal messages fill differently becomes a wildcard; this is
found by counting messages with one place left out, so it depends on no order and gathers no leaf in one task. A template is classified
once, by how much of it the vocabulary covers, by its cues, and by the documents and sources that hold it; the verdict goes back to every
document with one of its messages. Slots that were never filled are looked for in all documents, whatever their messages.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from http import HTTPStatus

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.session import cut

#: Tokens below the token count in the tree's path; messages of a leaf that must differ in a place to make it a wildcard.
DEPTH, WILD = 3, 3
#: Least share of a template's words that the vocabulary covers, and least score of its cues; the latter is one lower for a
#: template that so many documents hold as a message of its own, from so many sources (if sources are known).
COVER, SCORE, SUPPORT, SPREAD = 0.78, 3, 5, 2
#: Least share that makes a message enter the tree; wildcards may raise it.
LEAST = COVER - 0.3

# Marks of markup, and what a reader sees of it.
_CODE = regex.compile(r"(?s)(```|~~~).*?(?:\1|\Z)|``[^`]*``|`[^`\n]*`|<(pre|code|script|style)\b[^<>]*>.*?(?:</\2\s*>|\Z)|<!--.*?-->|(?m:^(?: {4}|\t)\S.*$)")
_MAYBE_CODE = regex.compile(r"[`<]|~~~|^(?: {4}|\t)", regex.M)
_HTML = regex.compile(r"(?i)(?<!<)</?(?:html|head|body|title|h[1-6]|p|br|b|i|u|em|strong|small|div|span|ul|ol|li|a|table|tr|td|th|hr|center|font|section|article|main|noscript|img|blockquote)\b[^<>]*>(?!>)")
_BREAK = regex.compile(r"(?i)(?<!<)<(?:br|/p|p|/h[1-6]|h[1-6]|/?div|/?li|/?tr|/?title|hr)\b[^<>]*>(?!>)")
_MATH = regex.compile(r"\$[^$\n]*\\[^$\n]*\$|\$[^$\n]*[_^]\{[^$\n]*\$")
_QUOTED = regex.compile(r"“[^”\n]{1,200}”|„[^“”\n]{1,200}[“”]|«[^»\n]{1,200}»|「[^」\n]{1,200}」|\"[^\"\n]{1,200}\"|(?<![\p{L}\p{N}])['‘][^'’\n]{1,80}['’](?![\p{L}\p{N}])")
_INVISIBLE = regex.compile(r"[\p{Cf}--[؀-؅]]", regex.V1)

# The ways of writing an unfilled slot.
_NAME = r"[A-Za-z][\w.\- ]{0,40}"
SLOTS = regex.compile(
    r"\{\{[#/^&>]?\s*[\w.\-| '\"():]{1,60}\}\}"  # {{name}} {{ name | default }} {{#name}}
    r"|\{%[^%{}\n]{1,80}%\}|\[%[^%\[\]\n]{1,80}%\]|<%[^%<>\n]{1,80}%>|<\?[^?<>\n]{1,80}\?>"
    r"|[$#]\{[A-Za-z_][\w.]*\}|\$\([A-Za-z_][\w.]*\)|\(\$\s*[A-Za-z_][\w.]*\s*\$\)|\(\([A-Za-z_][\w.]*\)\)"
    r"|%\([A-Za-z_]\w*\)[sdifr]|%%[A-Za-z_]\w*%%|!![A-Za-z_]\w*!!|(?<![\w%])%[A-Z_]{3,}%(?!\w)"
    r"|(?<![\w_])__[A-Za-z][A-Za-z_]*?__(?![\w_])|(?<![\w@])@[A-Za-z_]{2,}@(?![\w@])|<<[A-Za-z_][\w ]*>>"
    r"|(?<![\\\w_^{}$])\{(?:[A-Za-z_]+|\d)\}(?!\})|\[\[" + _NAME + r"\]\]"
    r"|\[(?i:insert|enter|add|your)\s[^\[\]\n]{1,50}\]|<(?i:insert|enter|your)\s[^<>\n]{1,50}>|[\[<][^\[\]<>\n]{1,50}\s(?i:goes here|here)[\]>]"
    r"|<var\s[^<>\n]{1,40}>|\[object Object\]|(?<!\w)X{4,}(?!\w)"
    r"|\[(?!UNK|PAD|MASK|CLS|SEP|BOS|EOS)[A-Z][a-z]+(?: [A-Z][a-z]+)*\](?!\()"
    r"|(?<![\w%])%s(?!\w)"
)
_MAYBE_SLOT = regex.compile(r"[{\[<%$#!_@&]|\(\(|XXXX")
_ENTITY = regex.compile(r"&([A-Za-z_]{2,30});")
_EMPTY_FIELD = regex.compile(r"(?m)^[ \t]*\p{Lu}[\p{L} ]{1,24}:[ \t]*(?:_{2,}|-{2,}|\?+|\.{2,}|…|)[ \t]*$")

# Vocabulary of pages that fail, by weight. None of it is a whole message.
_FAILS = """
error errors denied forbidden unauthorized unavailable expired refused timeout timed-out maintenance oops whoops broken crashed exceeded unreachable
failed failure exception overloaded gone incident not-found went-wrong rate-limit too-many
fehler serverfehler verweigert abgelaufen fehlgeschlagen wartungsarbeiten überlastet
erreur refusé indisponible introuvable expirée interdit échec
denegado caducado prohibido fallo mantenimiento
""".split()
_WEB = """
page pages site browsers navegador navigateur website web server service request requests requested response connection network host url link address session account permission
access login log-in http https browser upstream origin proxy gateway internal unexpected temporarily unauthorised something looking-for persists problem contact
owner administrator team told notified informed again later retry try reload refresh wait loading checking verifying redirecting reached id status valid fatal
seite server dienst zugriff anfrage sitzung später einmal erneut versuchen neu interner
serveur service accès momentanément plus tard réessayer session connexion
página servidor acceso sesión nuevo inténtelo tarde servicio solicitud conexión
""".split()
# Verbs and nouns that report a failure after a negation, and negations.
_NOT = "not no cannot can't couldn't doesn't don't isn't wasn't unable never nicht kein keine non pas no ne sin".split()
_NEGATED = """
found find exist exists available answer respond load process complete connect reach reached display open permitted allowed authorized authorised valid permission access
work works working gefunden verfügbar erreichbar erlaubt trouvée trouvé disponible autorisé encontrada encontrado encontró existe permitido
""".split()
# Words of notices that scripts are needed: what is needed, and that it is.
_SCRIPT = "javascript java-script script scripts scripting cookies ecmascript skripte scripte".split()
_ENABLE = """
enable enabled turn-on switch-on turned-on switched-on activate activated allow require requires required need needs must disabled turned-off switched-off support supported without
aktivieren einschalten erforderlich benötigt activer activez nécessaire requis active activar habilite habilitar necesario requiere
""".split()
# Words of filler.
_EMPTY = """
placeholder dummy tbd todo coming-soon left-blank to-follow goes-here text-here content-here under-construction hier-steht your-text insert
be-written be-added be-announced be-done
""".split()
_FILL = "text content sample here paragraph title description section layout add enter write fill copy image heading site page construction später example put type more".split()
# Common words that say nothing either way.
_PLAIN = """
a an the this that these it its you your we our us i my they he she is are was were be been being has have had do does did will would could should may might can to of on in at for from by with
or and if please then what which when while as about into out up down back go goes on off only line so than very much many sorry looks like just view see run use continue check start home sent
was not no soon old now moment minute minutes seconds there here how who why answer asked find time times name user file code number reference please
der die das ein eine einen dem den und oder zu um auf in ist sind wurde sie es ihr ihre ihrem ihren bitte noch diese dieser dieses sehen kann nicht von mit für wird hier
le la les un une des et ou à de du en est sont vous votre cette ce veuillez pour dans au aux par sur
el los las una y o al en continuar continuer fortfahren del por favor su sus en este esta para que con más se
app application needs its
""".split()
# The letters under resting fingers, of which nothing but filler consists.
_HOME_ROW = frozenset("asdfghjkl")
#: Reason phrases of HTTP statuses that report a failure.
_REASONS = frozenset(s.phrase.casefold() for s in HTTPStatus if s >= 400) | {"gateway time-out", "request time-out", "page not found", "server error"}
# The same for Chinese, by characters.
_HAN = regex.compile(
    r"(?P<fails>不存在|找不到|未找到|错误|出错|拒绝|禁止|无法|失败|超时|维护|不可用|过期)|(?P<web>页面|网页|网站|服务器|服务|浏览器|请求|访问|连接|稍后|重试|再试|刷新|登录|本页|该页)"
    r"|(?P<script>脚本)|(?P<enable>启用|开启|打开|允许|激活)|(?P<empty>占位|待补充|敬请期待)|(?P<fill>文本|文字|内容|此处)|(?P<plain>请|您|你|的|了|后|再|本|该|此|在|中|已|被|将|与|和|或|以|继续|浏览|查看|使用|需要)"
)
# Words of the mock Latin that typesetters use, from its classical passage and the usual generators.
LATIN = frozenset(
    """
lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam nostrud exercitation ullamco laboris nisi
aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa
officia deserunt mollit anim laborum vivamus sagittis lacus augue laoreet rutrum faucibus auctor donec mattis maecenas faucibus praesent cursus vestibulum ligula porta
felis euismod semper nullam quis risus eget urna mollis ornare leo cras justo odio dapibus facilisis egestas sed integer posuere erat ante venenatis aenean lacinia
bibendum sociis natoque penatibus magnis parturient montes nascetur ridiculus mus fermentum massa curabitur blandit tempus porttitor nibh ultricies vehicula ut id
morbi pellentesque habitant tristique senectus netus malesuada fames turpis phasellus suspendisse potenti quisque convallis sodales hendrerit
""".split()
)
#: Words that stand in living languages too: they count beside others only.
_LATIN_SHORT = frozenset("sed do ut et ad ex ea in id est non eu qui sit quis ante leo vel a ac at".split())
_STOP = frozenset("the of and is to that was for with der die und ist den les des une dans est que los las para con el la le it are".split())

_WEIGHT: dict[str, tuple[str, int]] = {}
for _kind, _weight, _words in (("plain", 0, _PLAIN), ("fill", 1, _FILL), ("web", 1, _WEB), ("enable", 2, _ENABLE), ("empty", 2, _EMPTY), ("script", 1, _SCRIPT), ("fails", 2, _FAILS)):
    _WEIGHT |= {w: (_kind, _weight) for w in _words}
_FILLS, _WEBS, _PLAINS = frozenset(_FILL), frozenset(_WEB), frozenset(_PLAIN)
_NOTS, _NEGATEDS = frozenset(_NOT), frozenset(_NEGATED)
#: Two words that are one entry of the vocabulary.
_TWO = {tuple(w.split("-")) for ws in (_FAILS, _WEB, _SCRIPT, _ENABLE, _EMPTY) for w in ws if w.count("-") == 1}
#: A message without any of these words is no template; they are looked for first. Of two words that are one entry the second stands for both.
_CUES = frozenset(w for ws in (_FAILS, _WEB, _SCRIPT, _EMPTY, _NEGATED) for w in ws if "-" not in w) | frozenset(b if b not in _PLAINS else a for a, b in _TWO) - {"log"} | LATIN - _LATIN_SHORT | {"xxx"}

#: What varies between messages of one template, with what stands for it.
_MASKS = [
    ("/", regex.compile(r"/[^\s/]+/\S+|https?://\S+"), "<path>"),
    ("/", regex.compile(r"[^\s/]+/<?\d[\d.]*"), "<product>"),
    ("()", regex.compile(r"\S*_\S*\(\)"), "<name>()"),
    ("", regex.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{8,}\b"), "<id>"),
    ("", regex.compile(r"\b[45]\d\d\b(?![.,:]?\d)"), "<status>"),
    ("", regex.compile(r"\d+(?:[.,:]\d+)*"), "<n>"),
]
_DIGIT = regex.compile(r"\d")
_SENTENCE = re.compile(r"([.!?…])\s+")
_TOKEN = re.compile(r"<[a-z*]+>|[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_MASH = regex.compile(r"^[asdfghjkl]{3,}\s[asdfghjkl\s]{9,}")
_LETTERS = regex.compile(r"\p{L}+")
_XXX = regex.compile(r"xxx(?: xxx)*")
_EDGES = " \t.!?…。！:;-–—*#•[]()"
_HANS = regex.compile(r"\p{Han}")
_STATUS = regex.compile(r"(?:http|error|status|code|http error|error code|status code)[ /:#-]*<status>|<status>[ :-]*error")
_BEFORE = regex.compile(r"(?:http|error|<status>|[ /:#-])+")


def shown(text: str) -> str:
    """The text as a page shows it, without code and formulas; entities decoded."""
    if _MAYBE_CODE.search(text):
        text = _CODE.sub(" ", text)
    if "<" in text:
        text = _HTML.sub("", _BREAK.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    if text.count("$") > 1:
        text = _MATH.sub(" ", text)
    return text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))


def has_slot(text: str) -> bool:
    """Whether `shown` text without quotations has a slot that was never filled."""
    if _MAYBE_SLOT.search(text) and (SLOTS.search(text) or _ENTITY.search(text)):
        return True
    return text.count(":") > 1 and len(_EMPTY_FIELD.findall(text)) >= 2


def unquoted(page: str) -> str:
    return _QUOTED.sub(" ", page)


def mask(message: str) -> str:
    digits = _DIGIT.search(message) is not None
    for sign, pattern, m in _MASKS:
        if sign in message and (sign or digits):
            message = pattern.sub(m, message)
    return " ".join(message.split())


def parts(text: str) -> list[str]:
    """Lines, sentences, and what stands between dashes."""
    for mark in "。！？":
        if mark in text:
            text = text.replace(mark, mark + "\n")
    for mark in (" - ", " – ", " — ", " | "):
        text = text.replace(mark, "\n")
    return _SENTENCE.sub(r"\1\n", text).split("\n")


def messages(text: str) -> set[str]:
    """The masked lines and sentences of a shown text without quotations, of those that hold a cue."""
    out = set()
    for part in parts(text.casefold()):
        if not part:
            continue
        if "’" in part:
            part = part.replace("’", "'")
        if not _CUES.isdisjoint(_TOKEN.findall(part)) or part.strip(_EDGES) in _REASONS or _MASH.search(part) or (not part.isascii() and any(m.lastgroup != "plain" for m in _HAN.finditer(part))):
            out.add(mask(part))
    out.discard("")
    return out


def parsed(template: str) -> list[str]:
    """Words of a template, those that make one entry of the vocabulary joined."""
    words = _TOKEN.findall(template)
    out, i = [], 0
    while i < len(words):
        if tuple(words[i : i + 2]) in _TWO:
            out.append(f"{words[i]}-{words[i + 1]}")
            i += 2
        else:
            out.append(words[i])
            i += 1
    return out


def evidence(template: str) -> tuple[float, dict[str, int]]:
    """(share of the words that the vocabulary covers, score by kind of cue); wildcards and masks count for neither."""
    words = parsed(template)
    known = total = 0
    seen: dict[str, set[str]] = {}
    if han := _HANS.findall(template):
        total += len(han)
        for m in _HAN.finditer(template):
            known += len(m[0])
            seen.setdefault(m.lastgroup or "", set()).add(m[0])
        words = [w for w in words if not _HANS.search(w)]
    for k, w in enumerate(words):
        if w[0] == "<":
            if w in ("<id>", "<status>", "<path>"):
                seen.setdefault("web", set()).add(w)
            continue
        total += 1
        entry = _WEIGHT.get(w)
        negated = w in _NEGATEDS and not _NOTS.isdisjoint(words[max(0, k - 3) : k])
        if negated:
            seen.setdefault("fails", set()).add("not")
        if w in _FILLS:
            seen.setdefault("fill", set()).add(w)
        if entry is not None or negated or w in _NOTS:
            known += 1
            if entry:
                seen.setdefault(entry[0], set()).add(w)
    return (known / total if total else 0.0), {k: len(v) for k, v in seen.items()}


def plain_verdict(template: str) -> str | None:
    """The verdict on reasons of a status, mock Latin and letters typed at random, whatever the rest of the vocabulary."""
    bare = template.lstrip("> ").strip(_EDGES)
    if bare in _REASONS or "<status>" in bare and (_STATUS.fullmatch(bare) or _BEFORE.sub(" ", bare, count=1).strip() in _REASONS):
        return "error"
    words = _LETTERS.findall(bare)
    latin = sum(w in LATIN for w in words)
    if latin > 2 and latin + sum(w in _LATIN_SHORT for w in words) >= 0.7 * len(words):
        return "filler"
    if latin > 1 and len(words) > 3 and latin >= 0.15 * len(words) and len({w for w in words if w in LATIN}) > 1 and _STOP.isdisjoint(words):
        return "filler"
    if _XXX.fullmatch(bare) or len(words) > 1 and len("".join(words)) >= 12 and _HOME_ROW.issuperset("".join(words)):
        return "filler"
    return None


def classify(template: str, documents: int = 1, sources: int | None = None) -> str | None:
    """error, notice, filler or None for a template that so many documents of so many sources hold."""
    if (kind := plain_verdict(template)) is not None:
        return kind
    cover, n = evidence(template)
    least = SCORE - (documents >= SUPPORT and (sources is None or sources >= SPREAD))
    if cover < COVER:
        return None
    fails, web = n.get("fails", 0), n.get("web", 0)
    if n.get("script", 0) and n.get("enable", 0):
        return "notice"
    if n.get("empty", 0) and 2 * n["empty"] + n.get("fill", 0) + (cover == 1) >= least:
        return "filler"
    if (web or fails > 1) and 2 * fails + web >= least:
        return "error"
    return None


def leaf(tokens: list[str]) -> str:
    """Path in the tree: the number of tokens, then the first ones."""
    return " ".join([str(len(tokens)), *tokens[:DEPTH]])


def _gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gap, place, template): each template with each place below the tree's path left out, as a hash of the rest."""
    import xxhash

    for b in batches:
        rows = []
        for t in b["template"]:
            tokens = t.split()
            if len(tokens) <= DEPTH:
                continue
            with np.errstate(over="ignore"):
                h = np.array([xxhash.xxh64_intdigest(w) for w in tokens], np.uint64) * np.cumprod(np.full(len(tokens), 0x9E3779B97F4A7C15, np.uint64))
                whole = h.sum(dtype=np.uint64) + np.uint64(xxhash.xxh64_intdigest(leaf(tokens)))
                gap = (whole - h).astype(np.int64)
            rows += [(int(gap[i]), i, t) for i in range(DEPTH, len(tokens))]
        yield pd.DataFrame(rows, columns=["gap", "place", "template"]).astype({"gap": "int64", "place": "int32", "template": object})


def mined(held: DataFrame) -> DataFrame:
    """(template, general, documents, sources): each message with its template, and how many documents and sources hold the template.

    `held` is (doc, source, template), one row per document and distinct message.
    """
    gaps = cut(held.select("template").distinct().mapInPandas(_gaps, "gap long, place int, template string"))
    varied = gaps.groupBy("gap", "place").agg(F.count("*").alias("n")).where(F.col("n") >= WILD).select("gap", "place")
    places = gaps.join(varied, ["gap", "place"]).groupBy("template").agg(F.collect_set("place").alias("places"))
    tokens = F.split("template", " ")
    general = F.array_join(F.transform(tokens, lambda t, i: F.when(F.array_contains("places", i), F.lit("<*>")).otherwise(t)), " ")
    named = held.join(places, "template", "left").withColumn("general", F.when(F.col("places").isNull(), F.col("template")).otherwise(general))
    support = named.groupBy("general").agg(F.count_distinct("doc").alias("documents"), F.count_distinct("source").alias("sources"))
    return named.select("template", "general").distinct().join(support, "general")


def find_residue(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str | None = "source") -> DataFrame:
    """(key, kind): documents with template residue, one row per kind: slot, error, notice or filler.

    Null, empty and blank texts hold none; a null key is no row. Matter in code or quotation marks, and prose about it, isn't residue.
    Without a column `source` the spread over sources isn't asked for.
    """
    kind = dict(docs.dtypes)[key]
    known = source is not None and source in docs.columns

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, s, t in zip(b["doc"], b["source"], b["text"]):
                if not t or not t.strip():
                    continue
                page = unquoted(shown(t))
                if has_slot(page):
                    rows.append((k, s, None))
                rows.extend((k, s, m) for m in messages(page) if evidence(m)[0] >= LEAST or plain_verdict(m) is not None)
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "source", "template"]).astype({"source": object, "template": object})

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # a wildcard is no evidence; the message's own words may be
            b = b.assign(kind=[classify(g, n, s if known else None) or classify(t, n, s if known else None) for g, t, n, s in zip(b["general"], b["template"], b["documents"], b["sources"])])
            yield b.loc[b["kind"].notna(), ["template", "kind"]]

    columns = [F.col(key).alias("doc"), (F.col(source) if known else F.lit(None)).cast("string").alias("source"), F.col(text).alias("text")]
    held = cut(docs.where(F.col(key).isNotNull()).select(*columns).mapInPandas(read, f"doc {kind}, source string, template string"))
    said = held.where("template is not null")
    verdicts = mined(said).mapInPandas(judge, "template string, kind string")
    by_template = said.join(verdicts, "template").select("doc", "kind")
    return held.where("template is null").select("doc", F.lit("slot").alias("kind")).unionByName(by_template).distinct().withColumnRenamed("doc", key)


def without_residue(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str | None = "source") -> DataFrame:
    """The rows of `docs` whose document holds no residue; rows with a null key stay."""
    return docs.join(find_residue(docs, key, text, source).select(key).distinct(), key, "left_anti")
