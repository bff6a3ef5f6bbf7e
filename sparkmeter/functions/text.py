"""Text features as native Column expressions.

Regexes run on Java's engine: ``(?U)`` makes \\w \\W \\b \\s \\d Unicode-aware.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: must equal the published definitions ---------------------------------
CJK = "[ᄀ-ᇿ぀-ヿ㄰-㆏㐀-鿿가-힯豈-﫿]"
PII = (
    r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+",
    r"(?U)https?://\S+|www\.\S+",
    r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"(?U)\b(?:sk|pk|ghp|gho|xox[abp]|AKIA)[-_A-Za-z0-9]{12,}\b",
    r"(?U)\b[A-Za-z0-9_\-]{32,}\b",
    r"(?U)\+?\d[\d\s\-().]{7,}\d",
)
FENCE = r"(?sd)```[^\n]*\n.*?(?:```|$)"
WORD = r"[A-Za-z][A-Za-z0-9+#]*(?:[.\-][A-Za-z0-9+#]+)*|[가-힣]{2,}|[一-鿿぀-ヿ]{2,}"
TERM = r"[A-Za-z_][A-Za-z0-9_./\-]{5,}|[가-힣]{3,}|[0-9]{4,}"
SHORT_WORDS = "ai ui ux db go js ts ml os c# c++ r".split()
KO_SUFFIXES = """
    입니다 습니다 합니다 해주세요 해줘요 해줘 해주 하세요 할까요 인가요 일까요 했는데 하는데 하려면
    에서는 에게서 으로는 으로서 으로써 이라고 이라는 라고 라는 처럼 보다 부터 까지 마다 조차 이나
    이랑 하고 에서 에게 한테 으로 로서 로써 이며 이고 인데 이요 이다 했다 한다 하는 하고 해서 하면
    은 는 이 가 을 를 에 의 도 만 로 와 과 나 랑 요 죠 다 고 며
""".split()
STOP_EN = """
    a an the and or but if then else of to in on at by for with about from into over under as is are was
    were be been being do does did doing have has had having i me my we our you your he she it its they
    them their this that these those there here what which who whom whose when where why how can could
    would should will shall may might must not no yes ok okay so just also very really more most less
    some any all each every both few many much other such only own same than too s t don doesn didn isn
    aren wasn weren won wouldn shouldn couldn let lets get got make made use used using like want need
    please thanks thank hi hello hey sure great good nice well now one two first second new way thing
    things something anything everything give tell show explain write help know think see look try
    example examples following above below based case cases e.g i.e etc vs via per able
""".split()
STOP_KO = """
    그리고 그러나 그런데 하지만 그래서 그러면 또는 혹은 및 등 등등 것 거 수 때 중 더 좀 잘 왜 뭐 무엇
    어떻게 어떤 이런 저런 그런 이것 저것 그것 여기 저기 거기 우리 저희 제가 내가 너무 정말 진짜 아주
    매우 다시 계속 지금 이제 먼저 그냥 혹시 만약 경우 부분 관련 대한 대해 위해 통해 같은 같이 다른
    가능 있다 없다 있는 없는 있어 없어 있습 없습 하다 해요 했어 되다 된다 되는 됩니다 감사 고마워
    감사합니다 안녕 안녕하세요 네 예 아니 아니요 응 그래 알겠 알려 알려줘 설명 설명해 해줘 주세요
    예시 예를 정도 이상 이하 사용 방법 내용 생각 질문 답변 문제 부탁 제발 하나 두 번째 첫째 둘째
""".split()
FNV_PRIME = 0x01000193
FNV_BASIS_LOW = 0x811C9DC5
FNV_BASIS_HIGH = 0x050C5D1F
LANGUAGE_WEIGHTS = (("ko", "[가-힣]", 2.0), ("ja", "[぀-ヿ]", 2.0), ("zh", "[一-鿿]", 2.0), ("en", "[A-Za-z]", 0.5))
# ------------------------------------------------------------------------------------------


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def estimate_tokens(text: Column | str) -> Column:
    """One token per CJK or Hangul character, one per four other characters, at least one."""
    text = col(text)
    rest = F.regexp_replace(text, CJK, "")
    plain = F.length(F.trim(F.regexp_replace(rest, r"(?U)\s+", " ")))
    n = F.greatest(F.lit(1), F.ceil(F.length(text) - F.length(rest) + plain / 4.0))
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(n).cast("bigint")


def scrub_pii(text: Column | str) -> Column:
    out = col(text)
    for pattern in PII:
        out = F.regexp_replace(out, pattern, " ")
    return out


def prose(text: Column | str) -> Column:
    return F.regexp_replace(col(text), FENCE, " ")


def has_code(text: Column | str) -> Column:
    return col(text).rlike(FENCE)


def _strip_suffix(word: Column) -> Column:
    # the shortest stem of two or more characters leaves the longest matching ending
    return F.regexp_replace(word, "^(.{2,}?)(?:" + "|".join(KO_SUFFIXES) + r")\z", "$1")


def content_words(text: Column | str) -> Column:
    """Normalised content words in order, repeats kept; code and personal data removed first."""
    raw = F.regexp_extract_all(scrub_pii(prose(text)), F.lit(WORD), F.lit(0))

    def between(w: Column, first: str, last: str) -> Column:
        """Whether a word's first character lies in a range; strings compare by code points, with no regex per word."""
        return (w >= first) & (w < chr(ord(last) + 1))

    def normalise(w: Column) -> Column:  # a Latin word begins with a letter and ends without a dot or dash
        return F.when(between(w, "A", "Z") | between(w, "a", "z"), F.lower(w)).when(between(w, "가", "힣"), _strip_suffix(w)).otherwise(w)

    def keep(w: Column) -> Column:
        latin = ((F.length(w) >= 3) | w.isin(SHORT_WORDS)) & ~w.isin(STOP_EN)
        korean = (F.length(w) >= 2) & ~w.isin(STOP_KO) & ~w.isin(KO_SUFFIXES)
        return F.when(between(w, "a", "z"), latin).when(between(w, "가", "힣"), korean).otherwise(F.lit(True))

    return F.filter(F.transform(raw, normalise), keep)


def distinctive_terms(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(TERM), F.lit(0)))


def detect_language(text: Column | str) -> Column:
    text = col(text)
    scores = [(lang, (F.length(text) - F.length(F.regexp_replace(text, chars, ""))) * F.lit(w))
              for lang, chars, w in LANGUAGE_WEIGHTS]
    best = F.greatest(*[s for _, s in scores])
    out = F.when(best <= 0, F.lit("und"))
    for lang, s in scores:  # the first of equal scores wins
        out = out.when(s == best, F.lit(lang))
    return out


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays without repeats; 0 when either is empty."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / union)


def simhash_similarity(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0))


def fnv1a32(text: Column | str, basis: int = FNV_BASIS_LOW) -> Column:
    """Native fold over the UTF-8 bytes of a string."""
    data = F.hex(F.encode(col(text), "UTF-8"))
    at = F.sequence(F.lit(1), F.length(data) - 1, F.lit(2))
    steps = F.when(F.length(data) > 0, at).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        steps, F.lit(basis).cast("bigint"),
        lambda h, i: ((h.bitwiseXOR(F.conv(F.substring(data, i, F.lit(2)), 16, 10).cast("bigint")))
                      * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def hash64(text: Column | str) -> Column:
    high = F.shiftleft(fnv1a32(text, FNV_BASIS_HIGH), 32)
    return high.bitwiseOR(fnv1a32(text, FNV_BASIS_LOW))


def _fnv_on(state: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Both 32-bit hashes (rows of state) carried on over bytes data[at:at + size], another stretch for each column."""
    state = state.copy()
    order = np.argsort(-size, kind="stable")
    longest_first = -size[order]
    for i in range(int(size.max(initial=0))):
        on = order[:np.searchsorted(longest_first, -i)]  # those with more than i bytes
        state[:, on] = ((state[:, on] ^ data[at[on] + i]) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF)
    return state


def _fingerprints(words: pa.ListArray, fallback: pa.ListArray, salt: bytes) -> np.ndarray:
    """Fingerprints of a few rows: each distinct word and pair of neighbours is hashed once, bits are added up per row."""
    given = pc.coalesce(pc.list_value_length(words), pa.scalar(0, pa.int32()))
    feats = pc.if_else(pc.greater(given, 0), words, fallback)
    n = pc.coalesce(pc.list_value_length(feats), pa.scalar(0, pa.int32())).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros(len(n), np.uint64)
    if not n.sum():
        return out.view(np.int64)
    coded = feats.flatten().cast(pa.large_string()).dictionary_encode()
    code, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.large_binary())
    ends, data = (np.frombuffer(x, t) for x, t in zip(names.buffers()[1:], (np.int64, np.uint8)))
    at = ends[names.offset:names.offset + len(names)]
    size = ends[names.offset + 1:names.offset + len(names) + 1] - at
    start = np.array([[FNV_BASIS_LOW], [FNV_BASIS_HIGH]], np.uint64)
    for byte in salt:
        start = ((start ^ np.uint64(byte)) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF)
    data = data.astype(np.uint64)
    one = _fnv_on(np.repeat(start, len(names), axis=1), data, at, size)
    rows = np.repeat(np.arange(len(n)), n)
    inside = np.flatnonzero(rows[1:] == rows[:-1])
    pairs, pair = np.unique(code[inside] * len(names) + code[inside + 1], return_inverse=True)
    left, right = pairs // len(names), pairs % len(names)
    spaced = ((one[:, left] ^ np.uint64(32)) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF)
    two = _fnv_on(spaced, data, at[right], size[right])
    whole = lambda h: (h[1] << np.uint64(32)) | h[0]
    bits = lambda h: np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(n)
    ones = np.add.reduceat(bits(whole(one)[code]), np.cumsum(n)[some] - n[some], axis=0, dtype=np.int32)
    follow = np.maximum(n - 1, 0)
    many = np.flatnonzero(follow)
    if len(many):
        ones[np.searchsorted(some, many)] += np.add.reduceat(bits(whole(two)[pair]), np.cumsum(follow)[many] - follow[many], axis=0, dtype=np.int32)
    most = 2 * ones > (n + follow)[some][:, None]
    out[some] = np.packbits(most, axis=1, bitorder="little").view("<u8")[:, 0]
    return out.view(np.int64)


#: A task's Python holds this many words of a batch at a time, or one row's.
WORDS_AT_ONCE = 100_000


def fingerprint_rows(words: pa.ListArray, fallback: pa.ListArray, salt: bytes) -> np.ndarray:
    """Fingerprints of one Arrow batch, some rows at a time."""
    held = [pc.coalesce(pc.list_value_length(x), pa.scalar(0, pa.int32())).to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, fallback)]
    total, out, at = np.append(0, np.cumsum(held[0] + held[1])), [np.zeros(0, np.int64)], 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(total, total[at] + WORDS_AT_ONCE, "right")) - 1)
        out.append(_fingerprints(words.slice(at, to - at), fallback.slice(at, to - at), salt))
        at = to
    return np.concatenate(out)


def simhash_udf(key: bytes = b""):
    salt = key + b"\x00"

    @F.arrow_udf(T.LongType())
    def fingerprint(words: pa.Array, fallback: pa.Array) -> pa.Array:
        return pa.array(fingerprint_rows(words, fallback, salt))

    return fingerprint


def simhash64(words: Column | str, fallback: Column | str, key: bytes = b"") -> Column:
    """64-bit similarity fingerprint over words and adjacent pairs, salted by ``key``.

    ``words``: content words; ``fallback``: the tokens used when there are none.
    """
    words = col(words)
    none = F.coalesce(F.size(words), F.lit(0)) <= 0
    return simhash_udf(key)(words, F.when(none, col(fallback)))


def fallback_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"(?U)\w+"), F.lit(0))


def redact(text: Column | str, patterns: list[str], mark: str = "[가림]") -> Column:
    out = col(text)
    for p in patterns:
        if p.strip():
            out = F.regexp_replace(out, p, mark)
    return out


def shorten(text: Column | str, n: int) -> Column:
    """Collapse white space and cut to n characters, ellipsis included."""
    t = F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def parse_time(text: Column | str) -> Column:
    t = col(text)
    return F.try_to_timestamp(F.when(t.endswith("Z"), F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.lit("+00:00"))).otherwise(t))
