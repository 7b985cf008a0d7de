"""Secret scan: fixed patterns plus dictionary-primed zstandard novelty (operator 6).

The dictionary is trained here, on lines of text and code made by rule from the identifiers below, so it brings both strings to refer to
and the letter statistics by which zstandard codes even a short string: what no reference shortens costs as many bits as its letters are
unusual. Names and words come to 0.5 to 0.85 of what random strings of the same letters cost in the same place, repeats to far less.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import string

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tessera.llm.common import sliced

# The base patterns, by kind, and the least length of what they have to catch.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN = 8
KINDS = ("assign", "access", "hex", "novel")

# Words of code and configuration with which the compressor is primed.
IDENTIFIERS = (
    "abstract access account address admin alias allow append archive args array assert async attribute auth authorization await "
    "backend backup base64 batch begin binary boolean branch break bucket buffer build bytes cache callback catch certificate change "
    "channel charset class client cloud cluster code collection column command commit compile component config configuration connect "
    "connection const constant constructor container content context continue control cookie copy count create credential credentials "
    "current cursor data database dataset date debug default define delete deploy description destination dict directory disable display "
    "document domain double download driver element email enable encode encoding endpoint engine entity entry environment error event "
    "example except exception execute exit export expression extends external false feature field file filter final finally float folder "
    "format frame from function gateway generate global group handle handler hash header height host hostname http https identifier "
    "image implements import include index info init inline input insert install instance integer interface internal invalid item iterator "
    "json kernel key keyword label lambda language layout length level library limit line link list listen load local location lock logger "
    "login logout loop main manager mapping master match maximum member memory merge message metadata method metric minimum mode model "
    "module monitor mount name namespace native network node notification null number object offset open operator option order origin "
    "output override owner package page param parameter parent parse partition passphrase passwd password patch path pattern payload "
    "permission pipeline placeholder platform plugin pointer policy pool port prefix primary print private process production profile "
    "project prompt property protected protocol provider proxy public publish query queue random range read record redirect refresh region "
    "register release remote remove rename render replace repository request require resource response result return role root route router "
    "runtime sample schema scheduler scope script search secret section secure security select self sender sequence server service session "
    "setting shard shared signature simple single size snapshot socket sort source split stack staging start state static status storage "
    "store stream string struct style submit subnet subscribe suffix summary super switch sync system table target task template temp "
    "tenant test text thread throw timeout timestamp title token topic total trace transaction transform trigger true type undefined "
    "union unique update upload user username value variable vector vendor version view virtual visible volume wait warning webhook "
    "while widget width window worker workspace wrapper write yaml yield zone "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000000000000000 xxxxxxxxxxxxxxxxxxxx"
)
#: A word that makes what follows it sensitive, and what a secret there could look like.
SENSITIVE = re.compile(r"(?:passw|secret|token|api.?key|credential|auth|bearer|private.key|access.key|signature|ssh-)", re.I | re.A)
LEAST_CANDIDATE = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
REACH = 48
#: Lengths of surroundings over which the measure is averaged, how many random strings a candidate is held against, and the share of
#: their bits from which it is novel: between names and random strings, set on labelled strings made by rule (the tests report precision
#: and recall on others).
AROUND, DRAWS, NOVELTY = (136, 168, 200, 232), 6, 0.91
#: Of a line that goes on with a novel one less is asked.
CHAINED = 0.85
#: What may stand between two lines of one wrapped secret: a line break, as such or escaped, quotes and margins.
ADJOINS = re.compile(r"""[ \t"',\\]*(?:\r?\n|\\r?\\?n)[ \t"'>#*|]*""")
#: A private key in armour, up to its END line or, where that is missing, to whatever comes next.
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----(.*?)(-----END|(?=-----BEGIN)|\Z)", re.S)
_LINE_END = r"""(?=[ \t"',]*(?:\r?\n|\\[nr]|\Z))"""
#: Lines that a key without an END line goes on with: headers, key text.
KEY_LINES = re.compile(rf"""(?:{ADJOINS.pattern}(?:[A-Za-z][A-Za-z0-9-]*:\x20[^\n\\]*(?:{ADJOINS.pattern}(?={ADJOINS.pattern}))?|[A-Za-z0-9+/=]{{16,}}|(?=[A-Za-z]*[0-9+/=])[A-Za-z0-9+/=]+){_LINE_END})*""")
#: The last, short line of a wrapped secret.
TAIL = re.compile(rf"{ADJOINS.pattern}([A-Za-z0-9+/_=-]{{1,15}}){_LINE_END}")


_FORMS = (
    "{a}_{b} = {c}.{d}({e})", "{A}{B}.{c}{D}", "{a}-{b}-{c}-{n}", "/{a}/{b}/{c}.{d}", "{U}_{V}_{W}={c}", "the {a} of a {b} and the {c} is in {d}", "{a}.{b}.{c}:{n}",
    "https://{a}.{b}/{c}/{d}?{e}={n}", '"{a}": "{b} {c}",', "def {a}_{b}({c}, {d}): return {e}", "{A} {B} {C} and {d}, {e}.", "20{n:02}-{m:02}-{k:02}T{k:02}:{m:02}:00 {a} {b}", "{U}_{V}: {a}-{b}_{c}",
)


@functools.lru_cache(maxsize=1)
def dictionary(size: int = 16_384, samples: int = 1_200, seed: int = 7) -> bytes:
    """The trained dictionary: the same bytes each time. Trained where it is first asked for; ``scan`` sends it to the tasks."""
    rng, words, lines = random.Random(seed), [w for w in IDENTIFIERS.split() if w.isalpha() and w.islower()], []
    for _ in range(samples):
        w = [rng.choice(words) for _ in range(8)]
        parts = dict(zip("abcde", w, strict=False)) | {k: x.title() for k, x in zip("ABCD", w, strict=False)} | {k: x.upper() for k, x in zip("UVW", w[5:], strict=True)}
        numbers = {"n": rng.randrange(100), "m": rng.randrange(1, 13), "k": rng.randrange(1, 29)}
        lines.append("\n".join(f.format(**parts, **numbers) for f in rng.sample(_FORMS, 5)).encode())
    return zstandard.train_dictionary(size, [*lines, IDENTIFIERS.encode()], level=19).as_bytes()


@functools.lru_cache(maxsize=1)
def compressor(data: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=15)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data), compression_params=params)


def marginal_bits(strings: list[str], around: str, primed: bytes | None = None) -> list[float]:
    """Compressed bits that each string adds to the code around it and the dictionary.

    Sizes are whole bytes, so the mean over several lengths of surroundings is taken; a fixed text follows, so that a string is not the
    last of its block.
    """
    z, a, tail = compressor(primed or dictionary()), LEAD + around.encode("utf-8", "ignore"), LEAD[:60]
    before = sum(len(z.compress(a[-k:] + tail)) for k in AROUND)
    return [8 * (sum(len(z.compress(a[-k:] + b" " + s.encode() + b" " + tail)) for k in AROUND) - before) / len(AROUND) for s in strings]


def drawn(candidate: str) -> list[str]:
    """Random strings of the candidate's length and kinds of letters, always the same for it."""
    if HEX_LETTERS.issuperset(c for c in candidate if c.isalnum()):
        letters = sorted(HEX_LETTERS)
    else:
        letters = [c for kind in (string.ascii_lowercase, string.ascii_uppercase, string.digits) if not set(kind).isdisjoint(candidate) for c in kind]
    rng = random.Random(candidate)
    return ["".join(rng.choices(letters, k=len(candidate))) for _ in range(DRAWS)]


def novelty(candidate: str, around: str, primed: bytes | None = None) -> float:
    """Marginal compressed bytes of the candidate as a share of what random strings like it take in the same place."""
    mine, *others = marginal_bits([candidate, *drawn(candidate)], around, primed)
    return mine / (sum(others) / len(others))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, each kind leftmost and non-overlapping, without matches too short."""
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    return found + [(*m.span(), "hex") for m in HEX.finditer(text)]


def surroundings(text: str, start: int, end: int) -> str:
    """The text around a candidate, without other copies of it (of its longest part between equals signs)."""
    core = max(re.split(r"=(?=[^=])", text[start:end]), key=len)
    gone, half = "\0" * len(core), max(AROUND) // 2
    before = text[max(0, start - half - len(core)) : start].replace(core, gone)[-half:]
    after = text[end : end + half + len(core)].replace(core, gone)[:half]
    return (after + before).replace("\0", "")


#: Stands before all surroundings, so that short ones cost a string nothing.
LEAD = b"The value is read from the configuration of the service, checked by the handler and then written to the log, as said above. " * 2
HEX_LETTERS = frozenset("0123456789abcdef")


def is_novel(text: str, start: int, end: int, least: float, primed: bytes | None = None) -> bool:
    """Whether a string of at least two of small letters, capitals and digits has a novelty of ``least``."""
    candidate = text[start:end]
    small, capital, digit = (any(kind(c) for c in candidate) for kind in (str.islower, str.isupper, str.isdigit))
    if small + capital + digit < 2:
        return False
    if not small:
        candidate = candidate.lower()  # a name in capitals is a name
    return novelty(candidate, surroundings(text, start, end), primed) >= least


def key_blocks(text: str, least: float, primed: bytes | None = None) -> list[tuple[int, int]]:
    """What stands between the lines that begin and end a private key, where any of it is novel."""
    out = []
    if "PRIVATE KEY" in text:
        for m in KEY_BLOCK.finditer(text):
            start, end = m.span(1)
            if not m.group(2):
                end = KEY_LINES.match(text, start, end).end()
            if any(is_novel(text, *c.span(), least, primed) for c in CANDIDATE.finditer(text, start, end)):
                body = text[start:end]
                out.append((start + len(body) - len(body.lstrip()), start + len(body.rstrip())))
    return out


def novel_spans(text: str, base: list[tuple[int, int, str]], least: float = NOVELTY, primed: bytes | None = None) -> list[tuple[int, int, str]]:
    """Strings near a sensitive word that neither the dictionary nor their surroundings can compress, outside ``base``.

    The lines that adjoin such a string are near the word too, and of a private key all up to its END line is one span.
    """
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    blocks, runs = key_blocks(text, least, primed), (m.span() for m in CANDIDATE.finditer(text))
    out, k, b, last = [(*x, "novel") for x in blocks], 0, 0, None
    base, near = sorted(base), 0
    ends = list(itertools.accumulate((e for _, e, _ in base), max))
    for start, end in runs:
        while k < len(words) and words[k][1] + REACH < start:
            k += 1
        chained = last is not None and (gap := ADJOINS.match(text, last)) is not None and gap.end() >= start
        if chained:
            start = max(start, gap.end())
        else:
            # From the first sensitive word that the run is near to, or has in it.
            if k == len(words) or words[k][0] >= end:
                last = None
                continue
            start = max(start, words[k][0])
        last = None
        if end - start < LEAST_CANDIDATE:
            continue
        while b < len(blocks) and blocks[b][1] <= start:
            b += 1
        if b < len(blocks) and blocks[b][0] < end:
            continue
        last = end
        while near < len(base) and ends[near] <= start:
            near += 1
        if near < len(base) and any(s < end and start < e for s, e, _ in itertools.takewhile(lambda x: x[0] < end, base[near:])):
            continue
        if is_novel(text, start, end, least * (CHAINED if chained else 1), primed):
            out.append((start, end, "novel"))
            if chained and (tail := TAIL.match(text, end)) and (any(c.isdigit() for c in tail[1]) or tail[1].endswith("=")):
                out.append((*tail.span(1), "novel"))
        elif not chained:
            last = None
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return ",".join(f"{k}:{s}:{e}" for s, e, k in order)


def scan(docs: DataFrame, least_novelty: float = NOVELTY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and all spans (code points, end exclusive) of each row.

    Null and empty texts have no spans; repeated rows give repeated results; whole texts are scanned, in place, without a
    shuffle; an empty table gives an empty table.
    """
    primed = dictionary()

    def run(batches):
        for b in sliced(batches):
            cols: list[list] = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                novel = novel_spans(text, base, least_novelty, primed) if text and SENSITIVE.search(text) else []
                kinds = [k for _, _, k in base]
                sha = hashlib.sha256(joined(base).encode()).hexdigest()
                for c, v in zip(cols, (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(novel), sha, joined(base + novel)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The same rows with every span of ``text_col`` replaced by ``mask`` (overlapping spans as one); null stays null."""

    names = docs.columns
    place, primed = names.index(text_col), dictionary()

    def clean(text):
        if not text:
            return text
        base = base_spans(text)
        spans = sorted(base + (novel_spans(text, base, NOVELTY, primed) if SENSITIVE.search(text) else []))
        out, at = [], 0
        for s, e, _ in spans:
            if s >= at:
                out += [text[at:s], mask]
            at = max(at, e)
        return "".join(out) + text[at:]

    def run(batches):
        for b in sliced(batches):
            columns = list(b.columns)
            columns[place] = pa.array(map(clean, columns[place].to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
