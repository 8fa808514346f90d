"""Problem 10: texts that stop before their author did.

A structural check reads every text as a whole. Trailing blanks and a cut mark are set aside. An automaton with a stack
then follows all of the text: brackets and quotes, which a paragraph bounds; braces, markup tags, comments and code
fences, which nothing bounds; escapes. What is still open at the end speaks for a cut, unless the source leaves such
items open as a rule. Broken multibyte sequences, escapes and tags at the end speak for a cut too. Otherwise the last line
decides: an end in a list, a closed table row, a command, a reference, a separator, a greeting or a signature is complete;
a sentence without terminator is judged by baselines over all texts: how often its last words end a sentence and how
often they go on, how often a short fragment stands alone, how usual missing terminators are in its source, and at which
lengths texts of the source are cut off.

How it scales. Texts are read twice, in Arrow batches. The first pass gives a verdict per text, and hashes of the wordings
in doubt (a few per cent of the texts). The second counts these wordings in all sentences, on arrays of word hashes; which
wordings are in doubt is told by a bitmap of fixed size, so only counters of those are shuffled, summed per task first.
A full bitmap lets more counters through and changes no result. Nothing else is collected; a source with a third of all
texts is pre-aggregated like any other, and field limits are rows per source and length that pass a count.

Null and empty texts are never truncated. Repeated texts are judged alike, each as a row. Very long texts are read whole.
A missing source is the source 'unknown'. Without any texts the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..session import Scratch
from . import grams

# Terminators, pairs, cut marks, and the forms of lines whose end is complete as it is.
TERMINATORS = ".!?。！？"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "«": "»", "〔": "〕", "《": "》"}
OPENERS = {v: k for k, v in PAIRS.items()}
#: Tags that HTML never closes, and those whose end it lets authors leave out.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
LOOSE_TAGS = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup colgroup caption html head body rp rt".split())
_CUT_MARK = re.compile(r"\s*(?:\[(?:\.{2,}|…|more|cut|truncated|snip|continued)\]|\((?:\.{3}|…|more|cut|truncated|cont\.?|continued|mehr|más)\)|<(?:more|cut|truncated|snip)>|…+|\.{3,}|>>+)\s*$", re.I)
_LIST = re.compile(r"\s*(?:[-*•·‣–+]|\d{1,3}[.)]|[a-zA-Z][.)])\s+\S")
_COMMAND = re.compile(r"(?:\s{4,}\S|\t\S|\s*(?:\$|>|#!)\s?\S)")
_REFERENCE = re.compile(r"\s*(?:ref(?:erence|erencia)?|see|siehe|ver|cf|re|参见|编号)\s*[:：.]?\s*[A-Z]{1,5}[-/ ]?\d[\w/.-]*\s*$|\s*(?:ref|see|siehe|ver|参见)\s*[:：]|\s*https?://\S+\s*$", re.I)
_SEPARATOR = re.compile(r"\s*(?:[-*_=~#.·—–]\s*){2,}$|\s*(?:\*\s*){1,3}$")
_NOTE = re.compile(r"\s*[\[(<](?:end|ende|fin|eof|eot)\b[^\])>\n]*[\])>]\s*$", re.I)
_SIGNATURE = re.compile(r"\s*(?:--+\s|—\s?|~\s)\S|\s*(?:signed|gezeichnet|gez\.|firmado|fdo\.|签名|签字)\s*[:：.]", re.I)
_GREETING = re.compile(
    r"\s*(?:(?:kind|best|warm)?\s*regards|sincerely|yours(?: \w+)?|thanks?(?: you)?|cheers|mit freundlichen grüßen|(?:viele|beste|liebe|freundliche) grüße|danke(?: schön)?|"
    r"(?:un )?saludos?(?: cordial(?:es)?)?|atentamente|(?:muchas )?gracias|此致|敬礼|谢谢|祝好)\s*[,!.，。！]?\s*$",
    re.I,
)
_BROKEN = re.compile(r"[�\ud800-\udfff]$|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$|&(?:#\d*|#x[0-9a-fA-F]*|am?p?|apos?|lt?|gt?|qu?o?t?|nb?s?p?)?$")
_PERCENT = re.compile(r"%[0-9A-Fa-f]?$")
#: A tag without its end: a name, attributes, perhaps an open value.
_OPEN_TAG = re.compile(r"<(?:/?[a-zA-Z][\w:-]*(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"<>]*\"?|'[^'<>]*'?|[^\s\"'<>]*))?)*\s*/?|/|!-{0,2})$")
_DANGLING = re.compile(r"[,;、，；]\s*$")
_SENTENCE = re.compile(r"(?<!\.)[.!?](?!\.)(?:[\"'”’»)\]]*)(?=\s|$)|[。！？](?:[”’」』）]*)")
#: What the automaton stops at; everything between is passed over. Candidates are found by their first sign.
_CANDIDATE = re.compile(r"[`~<\n\r\\()\[\]{}（）【】「」『』«»〔〕《》\"“”„]")
_EVENT = re.compile(r"```+|~~~+|<!--|<(/?)([a-zA-Z][\w:-]*)(?:\s[^<>]*)?>|(\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)|\\.|[()\[\]{}（）【】「」『』«»〔〕《》\"“”„]", re.S)


@dataclass(frozen=True)
class Baselines:
    """What the counts are held against. All are numbers of texts or sentences, or ratios of such numbers.

    short_words: a fragment of at most so many words may be a remark or a formula; longer ones are sentences.
    tail_words, tail_signs: so many last words (signs) make the end of a sentence; fewer say little, more are seldom seen twice.
    long_words, long_signs: where sentences go on after those words more often than they end, so many are looked at.
    least_seen: a wording seen less often may be chance; least_ends: the same for ends, where one other sentence must agree.
    remark_share, formula_share: a remark may be cut from longer texts if these are more than so many times as many.
    limit_count: unterminated texts of one source and length from which on the length may be a field limit, ...
    limit_reach, limit_factor: ... if it holds this many times the mean of the lengths within reach.
    habit_count, habit_share: a source leaves an item open as a rule if so many texts have it, and this share of them is open.
    """

    short_words: int = 8
    tail_words: int = 3
    tail_signs: int = 4
    long_words: int = 5
    long_signs: int = 8
    least_seen: int = 3
    least_ends: int = 2
    remark_share: int = 200
    formula_share: int = 10
    limit_count: int = 5
    limit_reach: int = 20
    limit_factor: int = 5
    habit_count: int = 20
    habit_share: float = 0.5


def open_items(text: str) -> tuple[list[tuple[str, int]], set[str]]:
    """What is open at the end of the text, outermost first, with the position at which it began; and all kinds of items met.

    Kinds are the opening sign, '<' for tags, '<!--' and the fence. A blank line ends open brackets and quotes (authors
    forget them, or open a quote anew in each paragraph), but not braces, tags, comments and fences. A quote mark after a
    digit means inches and opens nothing; closers without opener, and signs that make a face, are passed over.
    """
    stack: list[tuple[str, int]] = []
    met: set[str] = set()
    inside = ""  # the fence or straight quote that hides all else

    def push(kind: str, at: int) -> None:
        stack.append((kind, at))
        met.add(kind[:1] if kind[1:2].isalpha() else kind)

    def pop(*kinds: str) -> None:
        """Closes the innermost of these kinds, with all that was opened since."""
        if any(k in kinds for k, _ in stack):
            while stack.pop()[0] not in kinds:
                pass

    done = 0
    for candidate in _CANDIDATE.finditer(text):
        at = candidate.start()
        m = _EVENT.match(text, at) if at >= done else None
        if not m:
            continue
        done, sign = m.end(), m.group()
        fence = sign[:3] in ("```", "~~~") and not text[max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1 : at].strip()
        if inside and inside != '"':
            if fence and sign.startswith(inside):
                stack.pop()
                inside = ""
        elif m.group(3):
            stack = [s for s in stack if s[0] == "{" or s[0][0] == "<"]
            inside = ""
        elif sign[0] == "\\":
            pass
        elif sign == '"':
            if inside:
                pop('"')
                inside = ""
            elif not text[at - 1 : at].isdigit():
                push('"', at)
                inside = '"'
        elif inside:
            pass
        elif fence:
            push(sign[:3], at)
            inside = sign
        elif sign == "<!--":
            end = text.find("-->", done)
            push(sign, at)
            if end < 0:
                break
            stack.pop()
            done = end + 3
        elif m.group(2):
            name = m.group(2).lower()
            if m.group(1):
                pop("<" + name)
            elif not sign.endswith("/>") and name not in VOID_TAGS and name not in LOOSE_TAGS and "://" not in sign:
                push("<" + name, at)
        elif sign in PAIRS:
            if not (sign == "(" and text[at - 1 : at] in (":", ";")):
                push(sign, at)
        elif sign == "“" and any(k == "„" for k, _ in stack):
            pop("„")  # a German quote ends with the sign that begins an English one
        elif sign in "“„":
            push(sign, at)
        elif sign == "”":
            pop("“", "„")
        elif sign in OPENERS:
            pop(OPENERS[sign])
    return [(k[:1] if k[1:2].isalpha() else k, at) for k, at in stack], met


@dataclass
class Shape:
    """verdict: 'complete', 'broken' (why says what), or 'open' with the last, unterminated sentence in why; 'marked' is as
    'open', for a text that a cut mark follows. open: kinds of items left open that speak for a cut; met: all kinds met.
    """

    verdict: str
    why: str
    open: tuple[str, ...] = ()
    met: tuple[str, ...] = ()


def _last_line(body: str) -> int:
    return max(body.rfind("\n"), body.rfind("\r")) + 1


def structure(text: str) -> Shape:
    body = text.rstrip()
    if not body:
        return Shape("complete", "blank")
    line = body[_last_line(body) :]
    if _BROKEN.search(line) or _OPEN_TAG.search(body, max(body.rfind("<"), 0)) or _half_escaped(line):
        return Shape("broken", "bytes, escape or markup")
    closing = any(p.match(line) for p in (_NOTE, _SEPARATOR, _GREETING, _SIGNATURE))
    mark = "" if closing else _cut_mark(line)
    if mark:
        body = body[: len(body) - len(mark)].rstrip()
        if not body:
            return Shape("complete", "mark alone")
        line = body[_last_line(body) :]
    stack, met = open_items(body)
    begin, stripped = len(body) - len(line), line.strip()
    # A closing line is the author's end, whatever brackets came before. In a list, command or reference an item of the
    # last line itself may stay open.
    form = not stripped.startswith(("{", "[", "|", "<")) and bool(_LIST.match(line) or _COMMAND.match(line) or _REFERENCE.match(line))
    lasting = lambda kind: kind in ("{", "<", "<!--", "```", "~~~")
    unclosed = tuple(sorted({k for k, at in stack if (lasting(k) or not closing) and (at < begin or not form)}))

    def shape(verdict: str, why: str) -> Shape:
        return Shape(verdict, why, unclosed, tuple(sorted(met)))

    if closing:
        return shape("complete", "closing line")
    if stripped.startswith("|"):
        return shape("complete", "table") if stripped.endswith("|") and len(stripped) > 1 else shape("broken", "table row")
    if form:
        return shape("complete", "list, command or reference")
    end = line.rstrip("\"'”’»)]）」』】“")
    if end and end[-1] in TERMINATORS and not mark.lstrip().startswith("."):
        return shape("complete", "terminated")
    if end != line.rstrip() or stripped.endswith(("}", ">", "```", "~~~")):
        return shape("complete", "closed")  # an end in a closed quote, bracket, block or tag
    if _DANGLING.search(line):
        return shape("broken", "comma at the end")
    return shape("marked" if mark else "open", _SENTENCE.split(line)[-1].strip())


def _half_escaped(line: str) -> bool:
    """A percent escape that lacks a digit, in an address or after other such escapes; elsewhere it is a per cent sign."""
    if not _PERCENT.search(line):
        return False
    last = line.split()[-1]
    return "://" in last or bool(re.search(r"%[0-9A-Fa-f]{2}", last[:-1]))


def _cut_mark(line: str) -> str:
    """The cut mark at the end of a line, with the blanks before it, or ''."""
    m = _CUT_MARK.search(line) if line[-1:] in (".", "…", "]", ")", ">") or line[-1:].isspace() else None
    return m.group() if m and m.group().strip() else ""


#: Wordings in doubt are marked in a bitmap of this many bits, half a megabyte, whatever the size of the input.
MARKS = 1 << 22
_DOCS = pa.schema([
    ("doc_id", pa.int64()), ("source", pa.string()), ("verdict", pa.string()), ("why", pa.string()), ("open", pa.list_(pa.string())), ("met", pa.list_(pa.string())),
    ("tail", pa.int64()), ("long_tail", pa.int64()), ("key", pa.int64()), ("parent", pa.int64()), ("whole", pa.bool_()), ("chars", pa.int64()), ("bytes", pa.int64()),
])
_DOCS_DDL = "doc_id long, source string, verdict string, why string, open array<string>, met array<string>, tail long, long_tail long, key long, parent long, whole boolean, chars long, bytes long"
_COUNTS_DDL = "wording long, ends long, goes_on long, stands long, opens long"


def _verdicts(b: Baselines):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text its verdict and, if it is in doubt, the hashes of its last words (tail), of the whole fragment (key, if
        it is short) and of the fragment without its last word (parent, 0 if nothing is left)."""
        for batch in batches:
            texts = batch.column(2).to_pylist()
            shapes = [structure(t) for t in texts]
            doubt = [i for i, s in enumerate(shapes) if s.verdict in ("open", "marked")]
            w = grams.words([" ".join(shapes[i].why.split()) for i in doubt])
            first, count = w.starts()
            last = first + count - 1
            tail, long_tail = (t[last].view(np.int64) for t in _both_tails(w, b))
            _, opening = grams.openings(w, b.short_words)
            found: dict[int, tuple] = {}
            for j, (s, n) in enumerate(zip(w.text[w.sentence[first]], count, strict=True)):
                key = int(opening[n - 1][j].view(np.int64)) if n <= b.short_words else None
                parent = int(opening[n - 2][j].view(np.int64)) if key is not None and n > 1 else 0
                found[doubt[s]] = int(tail[j]), int(long_tail[j]), key, parent  # a fragment of several sentences counts by its last
            rows = []
            for i, (s, t) in enumerate(zip(shapes, texts, strict=True)):
                words = found.get(i, (None,) * 4)
                body = t.strip()
                whole = i in found and body.startswith(s.why) and _cut_mark(body[len(s.why) :]).strip() == body[len(s.why) :].strip()
                why = s.why if s.verdict in ("complete", "broken") else None
                rows.append((s.verdict, why, list(s.open), list(s.met), *words, whole, len(t), len(t.encode("utf-8", "surrogatepass"))))
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(len(_DOCS) - 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *[pa.array(c, f.type) for c, f in zip(columns, list(_DOCS)[2:], strict=True)]], schema=_DOCS)

    return run


def _both_tails(w: grams.Words, b: Baselines) -> list[np.ndarray]:
    return grams.tails(w, ((b.tail_words, b.tail_signs), (b.long_words, b.long_signs)))


def _counters(marks: bytes, b: Baselines, chunk: int = 120_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each wording in doubt, over all terminated sentences: how many end with it, go on after it (as a tail), are
        just it, and begin with it and go on."""
        marked = np.unpackbits(np.frombuffer(marks, np.uint8), bitorder="little").astype(bool)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add(kind: int, wording: np.ndarray) -> None:
            wording = wording[marked[(wording & np.uint64(MARKS - 1)).astype(np.int64)]]
            if len(wording):
                held.append((wording, np.full(len(wording), kind, np.int8)))

        def count(texts: list[str]) -> None:
            w = grams.words(texts)
            if not len(w.hash):
                return
            first, n = w.starts()
            done = w.terminated[w.sentence[first]]
            ends = np.zeros(len(w.hash), bool)
            ends[(first + n - 1)[done]] = True
            for tails in _both_tails(w, b):
                add(0, tails[ends])
                add(1, tails[w.terminated[w.sentence] & ~ends])
            _, opening = grams.openings(w, b.short_words)
            for k, o in enumerate(opening):
                add(2, o[done & (n == k + 1)])
                add(3, o[done & (n > k + 1)])

        def flush() -> pa.RecordBatch:
            wording, kind = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            distinct, at = np.unique(wording, return_inverse=True)
            sums = [np.bincount(at[kind == k], minlength=len(distinct)) for k in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *[pa.array(s.astype(np.int64)) for s in sums]], names=["wording", "ends", "goes_on", "stands", "opens"])

        for batch in batches:
            texts, size = [], 0
            for t in batch.column(0).to_pylist():
                texts.append(_without_mark(t))
                size += len(texts[-1])
                if size >= chunk:
                    count(texts)
                    texts, size = [], 0
            count(texts)
            if sum(len(h[0]) for h in held) > 2_000_000:
                yield flush()
        if held:
            yield flush()

    return run


def _without_mark(text: str) -> str:
    body = text.rstrip()
    mark = _cut_mark(body[_last_line(body) :])
    return body[: len(body) - len(mark)] if mark else body


def _marks(wordings: DataFrame) -> bytes:
    """The bitmap of wordings: its parts come as rows of 4 kB, 128 at most."""
    bit = F.col("wording").bitwiseAND(F.lit(MARKS - 1))
    parts = wordings.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits"))
    out = bytearray(MARKS // 8)
    for r in parts.collect():
        out[r["part"] * 4096 : r["part"] * 4096 + 4096] = r["bits"]
    return bytes(out)


def judged(documents: DataFrame, scratch: Scratch | None = None, baselines: Baselines | None = None) -> DataFrame:
    """doc_id, source, truncated, reason for every row with a text."""
    b = baselines or Baselines()
    scratch = scratch or Scratch(documents.sparkSession, "truncation")
    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce(normal.key("source"), F.lit("unknown")).alias("source"), F.col("text").cast("string").alias("text")).where("text is not null")
    docs = scratch.keep(texts.mapInArrow(_verdicts(b), _DOCS_DDL), "verdicts")
    doubt = docs.where("verdict in ('open', 'marked')")
    wordings = doubt.select(F.explode(F.array_compact(F.array("tail", "long_tail", "key", "parent"))).alias("wording"))
    seen = texts.select("text").mapInArrow(_counters(_marks(wordings), b), _COUNTS_DDL).groupBy("wording").agg(*[F.sum(c).alias(c) for c in ("ends", "goes_on", "stands", "opens")])
    # Fragments in doubt count as well: those that are all of their text, and those that follow other sentences.
    own = doubt.where("key is not null").groupBy(F.col("key").alias("wording")).agg(F.count_if("whole").alias("wholes"), F.count_if(~F.col("whole")).alias("follow"))
    counts = scratch.keep(seen.join(own, "wording", "full"), "counts")
    zero = lambda c: F.coalesce(c, F.lit(0))
    of = lambda at, *names: counts.select(F.col("wording").alias(at), *[zero(c).alias(f"{at}_{c}") for c in names])
    doubt = doubt.join(of("tail", "ends", "goes_on"), "tail", "left").join(of("long_tail", "ends", "goes_on"), "long_tail", "left").join(of("key", "stands", "opens", "wholes", "follow"), "key", "left").join(of("parent", "opens"), "parent", "left")
    n_ends, n_opens, n_wholes, n_parent = zero("tail_ends"), zero("key_opens"), zero("key_wholes"), zero("parent_opens")
    n_stands = zero("key_stands") + zero("key_follow")
    # A short fragment is a remark of its own if it is the whole of several texts, or if it stands alone often (as a
    # closing formula does), and if sentences rarely go on from it, or from what precedes its last word, which may be
    # part of a word.
    whole = F.col("whole") & (n_wholes >= b.least_seen) & (n_wholes > n_opens) & (n_wholes * b.remark_share >= n_parent)
    formula = (n_stands >= b.least_seen) & (n_stands > n_opens) & (n_stands * b.formula_share >= n_parent) & (F.col("parent") != 0)
    doubt = doubt.withColumn("remark", F.col("key").isNotNull() & (whole | formula))
    # Sentences end with these words, and do so more often than they go on after them.
    ended = lambda t: (zero(f"{t}_ends") >= b.least_ends) & (zero(f"{t}_ends") > zero(f"{t}_goes_on"))
    known = F.when(F.col("key").isNull(), ended("tail") | ended("long_tail")).otherwise((n_ends >= b.least_ends) & ((n_opens == 0) | (n_ends > n_opens)))
    doubt = scratch.keep(doubt.withColumn("known_end", known).withColumn("n_opens", n_opens).drop("met", "why"), "doubt")
    # Lengths at which a source is cut off: many of its texts have just that length, and most of those stop short.
    short = (F.col("verdict") == "open") & ~F.col("remark")
    sizes = docs.where("verdict in ('complete', 'broken')").select("source", "chars", "bytes", F.lit(False).alias("short"))
    sizes = sizes.union(doubt.select("source", "chars", "bytes", short.alias("short")))
    each = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("size")) for u in ("chars", "bytes")]))
    sizes = sizes.select("source", "short", each.alias("x")).groupBy("source", "x.unit", "x.size").agg(F.count_if("short").alias("n_short"), F.count("*").alias("n"))
    near = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-b.limit_reach, b.limit_reach)
    sizes = sizes.withColumn("around", F.sum("n").over(near) - F.col("n"))
    limits = sizes.where((F.col("n_short") >= b.limit_count) & (F.col("n_short") * 2 > F.col("n")) & (F.col("n") * (2 * b.limit_reach) > F.col("around") * b.limit_factor))
    limits = limits.select("source", "unit", "size", F.lit(True).alias("limit"))
    for unit in ("chars", "bytes"):
        doubt = doubt.join(limits.where(F.col("unit") == unit).select("source", F.col("size").alias(unit), F.col("limit").alias(f"{unit}_limit")), ["source", unit], "left")
    doubt = doubt.withColumn("at_limit", F.coalesce("chars_limit", "bytes_limit").isNotNull())
    # What is usual in a source: how many of its texts lack a terminator, apart from remarks and those cut at a limit.
    all_ = docs.groupBy("source").agg(F.count("*").alias("all"))
    lacking = doubt.groupBy("source").agg(F.count_if((F.col("verdict") == "open") & ~F.col("remark") & ~F.col("at_limit")).alias("lacking"), F.count_if("at_limit").alias("cut"))
    usual = all_.join(lacking, "source").select("source", (F.col("lacking") * 2 > F.col("all") - F.col("cut")).alias("rarely_ended"))
    # And which items it leaves open: one row per source, with a few kinds of items.
    items = docs.select("source", F.explode("met").alias("item"), "open").groupBy("source", "item").agg(F.count("*").alias("n"), F.count_if(F.array_contains("open", F.col("item"))).alias("n_open"))
    habits = items.where((F.col("n") >= b.habit_count) & (F.col("n_open") > F.col("n") * b.habit_share)).groupBy("source").agg(F.collect_set("item").alias("habit"))
    unclosed = lambda df: df.join(habits, "source", "left").withColumn("unclosed", F.array_except("open", F.coalesce("habit", F.array().cast("array<string>"))))
    speaks = F.when(F.size("unclosed") > 0, F.concat(F.lit("unclosed "), F.element_at("unclosed", 1)))
    reason = (
        F.when(speaks.isNotNull(), speaks)
        .when(F.col("tail").isNull() | F.col("remark"), F.lit(None))
        .when(F.col("at_limit"), F.lit("field limit"))
        .when(F.col("verdict") == "marked", F.lit("cut mark in a sentence"))
        .when(F.col("known_end"), F.lit(None))
        .when(F.col("rarely_ended") & (F.col("n_opens") == 0), F.lit(None))
        .otherwise(F.lit("no end of sentence"))
    )
    doubted = unclosed(doubt.join(usual, "source")).select("doc_id", "source", reason.alias("reason"))
    plain = docs.where("verdict in ('complete', 'broken')")
    closed = plain.where(F.size("open") == 0).select("doc_id", "source", F.when(F.col("verdict") == "broken", F.col("why")).alias("reason"))
    left = unclosed(plain.where(F.size("open") > 0)).select("doc_id", "source", F.when(F.col("verdict") == "broken", F.col("why")).otherwise(speaks).alias("reason"))
    return closed.union(left).union(doubted).select("doc_id", "source", F.col("reason").isNotNull().alias("truncated"), "reason")


def truncated(documents: DataFrame, scratch: Scratch | None = None, baselines: Baselines | None = None) -> DataFrame:
    """doc_id of the truncated texts."""
    return judged(documents, scratch, baselines).where("truncated").select("doc_id").distinct()


def rates(documents: DataFrame, scratch: Scratch | None = None, baselines: Baselines | None = None) -> DataFrame:
    """source, n_texts, n_truncated, rate, and the counts by kind of evidence."""
    j = judged(documents, scratch, baselines)
    by = lambda name, cond: F.count_if(cond).alias(name)
    r = F.col("reason")
    return j.groupBy("source").agg(
        F.count("*").alias("n_texts"), by("n_truncated", F.col("truncated")), by("n_field_limit", r == "field limit"), by("n_cut_mark", r.startswith("cut mark")),
        by("n_no_end", r == "no end of sentence"), by("n_broken", F.col("truncated") & ~r.isin("field limit", "no end of sentence") & ~r.startswith("cut mark")),
    ).withColumn("rate", F.try_divide("n_truncated", "n_texts"))
