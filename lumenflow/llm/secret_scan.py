"""Secret scans: fixed patterns plus a randomness test battery with length-aware false-discovery control.

Patterns give the base spans (kinds assign, access, hex; the whole match, in code points, end
exclusive). The battery looks at every run of 20 or more characters of the base-64 alphabets: at the whole, and
where it has separators (- or _) also at each part of 20 or more characters, and at all hex digits together if there are
no others (as in UUIDs; other short parts together are too like names of several words). Forms without a letter are not judged. The
encoding is the smallest that the characters present allow (base 16, 26, 32, 36, 52, 58, 62 or 64; 16 to 36 in either case).
Four tests ask whether the symbols could be uniform random: chi-squared uniformity over the alphabet, and over its classes
(digits, signs, upper case, the twelve commonest lower-case letters of prose, the other ones), runs above and below the middle
symbol, and serial correlation of neighbouring symbols. The chi-squared tails are those of the gamma distribution with the
statistic's exact mean and variance (Wilson-Hilferty). p is the least of the four p-values, times four.

False discoveries are controlled per band of lengths by decoys: each form has DECOYS of its own length and class, names made
of words of the same text (joined as the form is: by its first separator, by capitals, or by nothing, with two last digits if it has any;
words of PROSE follow where a text is short of words). They are judged as forms are. Forms with p of at least a band's cut are
reported as kind random; the cut is the least one at which the decoys, and one more, divided by DECOYS are at most RATE of the forms.
So names and paths as random as prose is are not reported, whatever their case. A part found within a whole that is found
is not reported again. Counts per band and 1/100 of p are all that is gathered.

Only DataFrame functions are used. A null text is empty. Repeated rows give repeated rows; extra
columns stay, but for those named base, found, _t, _judged, _hits or _more; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
PART = r"[A-Za-z0-9+/]{20}"
RATE, LEAST_P = 0.025, 0.01
KINDS = ("assign", "access", "hex", "random")
DECOYS = 40
_LOW, _UP, _DIGITS, _COMMON = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "etaoinshrdlu"
ALPHABETS = {
    16: "0123456789abcdef", 26: _LOW, 32: "abcdefghijklmnopqrstuvwxyz234567", 36: _DIGITS + _LOW, 52: _UP + _LOW,
    58: "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", 62: _UP + _LOW + _DIGITS, 64: _UP + _LOW + _DIGITS + "+/",
}
#: The smallest encoding that the characters allow, by the first pattern that fits.
ENCODINGS = ((16, "[0-9]*([a-f][0-9a-f]*|[A-F][0-9A-F]*)"), (26, "[a-z]+|[A-Z]+"), (32, "[a-z2-7]+|[A-Z2-7]+"), (36, "[a-z0-9]+|[A-Z0-9]+"), (52, "[A-Za-z]+"), (58, "[1-9A-HJ-NP-Za-km-z]+"), (62, "[A-Za-z0-9]+"))
#: Words that names are made of, in code and in prose.
PROSE = ("key row column line text zone code error event group join block frame image video audio pixel color width height border margin layout view model option "
         "default enable disable begin finish insert delete select match replace format convert encode decode hash session header body status proxy host port network message "
         "queue task job worker batch schedule lock mutex random vector matrix scalar kernel driver device volume backup restore archive export import module package version "
         "branch commit remote origin fetch push pull review issue comment author license public private static final abstract virtual override template generic lambda closure "
         "people town long road back began few went bridge water tree field house money music history science language question answer country government company market").split()
WORD = r"(?<![A-Za-z0-9+/_-])[a-z]{2,15}(?![A-Za-z0-9+/_-])"


def _classes(k: int) -> list[str]:
    a = ALPHABETS[k]
    kinds = [[c for c in a if c.isdigit()], [c for c in a if c in "+/"], [c for c in a if c.isupper()], [c for c in a if c in _COMMON], [c for c in a if c.islower() and c not in _COMMON]]
    return ["".join(x) for x in kinds if x] if k > 16 else ["0123456789", "abcdef"]


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: int, pattern: str, least: int, group: int = 0, quick: str | None = None) -> str:
    """SQL: array of (start, kind, end, hit) of the matches whose group has `least` characters or more."""
    p = _q(pattern)
    kept = f"length(g[i]) >= {least}"
    return f"""CASE WHEN _t RLIKE {_q(quick or pattern)} THEN aggregate(array(named_struct(
        'l', transform(split(_t, {p}, -1), x -> length(x)), 'm', regexp_extract_all(_t, {p}, 0), 'g', regexp_extract_all(_t, {p}, {group}))),
        CAST(array() AS array<struct<start:int,kind:int,end:int,hit:string>>),
        (none, a) -> aggregate(sequence(0, size(a.m) - 1), named_struct('at', 0, 'out', none),
          (s, i) -> named_struct('at', s.at + a.l[i] + length(a.m[i]), 'out', IF({kept.replace('g[', 'a.g[')},
            concat(s.out, array(named_struct('start', s.at + a.l[i], 'kind', {kind}, 'end', s.at + a.l[i] + length(a.m[i]), 'hit', a.m[i]))), s.out))).out)
      ELSE CAST(array() AS array<struct<start:int,kind:int,end:int,hit:string>>) END"""


def _tail(z: str) -> str:
    """Upper tail of the normal distribution (logistic form, within 0.0002)."""
    return f"1 / (1 + exp(least(1.5976 * ({z}) + 0.070566 * pow({z}, 3), 700)))"


#: Runs to the forms that are judged: (start, end, s); the whole first, so that what it holds comes after it.
_FORMS = f"""flatten(transform(_runs, c -> aggregate(array(rtrim('=', c.hit)), CAST(array() AS array<struct<start:int,end:int,s:string>>), (none, h) -> concat(
    array(named_struct('start', c.start, 'end', c.end, 's', h)),
    IF(h RLIKE '[_-]' AND h RLIKE '^([0-9a-f_-]+|[0-9A-F_-]+)$' AND length(translate(h, '-_', '')) >= 20, array(named_struct('start', c.start, 'end', c.end, 's', translate(h, '-_', ''))), none),
    IF(h RLIKE '[_-]' AND h RLIKE {_q(PART)}, aggregate(split(h, '[_-]'), named_struct('at', c.start, 'out', none),
      (o, y) -> named_struct('at', o.at + length(y) + 1, 'out', IF(length(y) >= 20, concat(o.out, array(named_struct('start', o.at, 'end', o.at + length(y), 's', y))), o.out))).out, none)))))"""

_ENCODING = "CASE " + " ".join(f"WHEN c.s RLIKE '^({p})$' THEN {k}" for k, p in ENCODINGS) + " ELSE 64 END"
_ALPHABET = "CASE e.k " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in ALPHABETS.items()) + " END"
_CLASSES = "CASE e.k " + " ".join(f"WHEN {k} THEN array({', '.join(map(_q, _classes(k)))})" for k in ALPHABETS) + " END"


def _gamma_tail(x: str, mean: str, var: str) -> str:
    """Upper tail of the gamma distribution of that mean and variance, by its cube root."""
    spread = f"(({var}) / (9 * ({mean}) * ({mean})))"
    return _tail(f"(pow(greatest(({x}) / ({mean}), 0.0D), 1 / 3.0D) - (1 - {spread})) / sqrt({spread})")


def _judge(forms: str) -> str:
    """SQL: an array of forms (start, end, s) to their length band and p."""
    symbols = _gamma_tail("v.k * v.same / CAST(v.n AS DOUBLE) - v.n", "v.k - 1", "2.0D * (v.k - 1) * (v.n - 1) / v.n")
    by_class = "aggregate(v.cells, 0.0D, (a, c) -> a + pow(length(v.s) - length(translate(v.s, c, '')) - v.n * length(c) / CAST(v.k AS DOUBLE), 2) / (v.n * length(c) / CAST(v.k AS DOUBLE)))"
    cells = "size(v.cells)"
    class_var = f"2 * ({cells} - 1) + (aggregate(v.cells, 0.0D, (a, c) -> a + v.k / CAST(length(c) AS DOUBLE)) - {cells} * {cells} - 2 * {cells} + 2) / v.n"
    runs = _tail("abs(aggregate(sequence(1, v.n - 1), 0, (a, i) -> a + IF((v.x[i] * 2 >= v.k) = (v.x[i - 1] * 2 >= v.k), 0, 1)) - (v.n - 1) / 2.0D) / sqrt((v.n - 1) / 4.0D)")
    serial = _tail("abs(aggregate(sequence(1, v.n - 1), 0.0D, (a, i) -> a + (v.x[i] - (v.k - 1) / 2.0D) * (v.x[i - 1] - (v.k - 1) / 2.0D))) / ((v.k * v.k - 1) / 12.0D) / sqrt(v.n - 1.0D)")
    return f"""transform({forms}, c -> aggregate(array(named_struct('s', translate(c.s, '-_', '+/'), 'k', {_ENCODING})),
      named_struct('start', c.start, 'kind', 3, 'end', c.end, 'band', 0, 'p', 0.0D),
      (z, f) -> aggregate(array(named_struct('s', IF(f.k <= 36, lower(f.s), f.s), 'k', f.k)), z, (y, e) -> aggregate(array(named_struct('s', e.s, 'n', length(e.s), 'k', e.k, 'cells', {_CLASSES},
          'x', transform(split(e.s, ''), w -> CAST(instr({_ALPHABET}, w) - 1 AS DOUBLE)),
          'same', aggregate(split(e.s, ''), 0, (a, w) -> a + length(e.s) - length(replace(e.s, w, ''))))), y,
        (o, v) -> named_struct('start', c.start, 'kind', 3, 'end', c.end, 'band', CAST(floor(2 * log2(v.n / 20.0D)) AS INT),
          'p', least(1.0D, 4 * least({symbols}, {_gamma_tail(by_class, f"({cells} - 1)", class_var)}, 2 * ({runs}), 2 * ({serial}))))))))"""


#: Decoys of all forms of a row: names of the form's length, from 24 words that follow a place of their own.
_DECOYS = f"""flatten(transform(_forms, c -> transform(sequence(1, {DECOYS}), j -> aggregate(array(named_struct(
    'w', transform(sequence(0, 23), i -> element_at(_words, CAST(pmod(xxhash64(c.s, j) + i, size(_words)) + 1 AS INT))),
    'by', regexp_extract(c.s, '[+/_-]', 0), 'two', c.s RLIKE '[a-z]' AND c.s RLIKE '[A-Z]', 'n', length(c.s))),
  named_struct('start', 0, 'end', 0, 's', ''), (z, d) -> named_struct('start', 0, 'end', 0, 's', concat(substring(repeat(
    IF(c.s RLIKE '^([0-9a-f_-]+|[0-9A-F_-]+)$', concat(translate(array_join(d.w, ''), 'ghijklmnopqrstuvwxyz', ''), 'a'),
      IF(c.s RLIKE '[a-z]', array_join(IF(d.two, transform(d.w, w -> concat(upper(substring(w, 1, 1)), substring(w, 2))), d.w), d.by), upper(array_join(d.w, d.by)))),
    d.n), 1, d.n - IF(c.s RLIKE '[0-9]', 2, 0)), IF(c.s RLIKE '[0-9]', CAST(10 + pmod(xxhash64(j, c.s), 90) AS STRING), '')))))))"""


def _with_forms(docs: DataFrame, text_col: str) -> DataFrame:
    d = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_runs", F.expr(_spans(3, RUN, 20)))
    return d.withColumn("_forms", F.expr(f"filter({_FORMS}, c -> c.s RLIKE '[A-Za-z]')")).drop("_runs")


def judged_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `_judged`: the forms of all runs with band and p."""
    return _with_forms(docs, text_col).withColumn("_judged", F.expr(_judge("_forms"))).drop("_forms")


def cuts(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> dict[int, float]:
    """Least p reported per length band. Bands are few: they grow with the logarithm of a run's length."""
    d = _with_forms(docs.select(F.col(text_col).alias("text")), "text").where("size(_forms) > 0")
    prose = "array(" + ", ".join(map(_q, PROSE)) + ")"
    d = d.withColumn("_words", F.expr(f"concat(regexp_extract_all(_t, {_q(WORD)}, 0), {prose})")).withColumn("_decoys", F.expr(_DECOYS))
    both = d.select(F.expr(_judge("_forms")).alias("t"), F.expr(_judge("_decoys")).alias("d"))
    every = F.concat(F.transform("t", lambda r: F.struct(r["band"], r["p"], F.lit(False).alias("decoy"))), F.transform("d", lambda r: F.struct(r["band"], r["p"], F.lit(True).alias("decoy"))))
    runs = both.select(F.explode(every).alias("r")).select("r.band", "r.p", "r.decoy")
    bins = runs.groupBy("band", F.floor(F.least(F.col("p"), F.lit(0.995)) * 100).cast("int").alias("bin")).agg(F.count_if("decoy").alias("d"), F.count_if(~F.col("decoy")).alias("t"))
    found: dict[int, float] = {}
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in bins.collect():  # at most 100 rows a band
        by.setdefault(r["band"], {})[r["bin"]] = (r["d"], r["t"])
    for band, rows in by.items():
        d = t = 0
        best = None
        for b in sorted(rows, reverse=True):
            d, t = d + rows[b][0], t + rows[b][1]
            if d + 1 <= rate * t * DECOYS:
                best = b
        if best is not None:
            found[band] = max(best / 100, LEAST_P)
    return found


def scan(docs: DataFrame, text_col: str = "text", rate: float = RATE, base_col: str = "base", found_col: str = "found") -> DataFrame:
    """docs plus base and found: arrays of (start, kind, end), kind an index of KINDS, sorted by start."""
    cut = cuts(docs, text_col, rate)
    d = judged_runs(docs, text_col)
    light = lambda e: f"transform({e}, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end))"
    base = f"concat({_spans(0, ASSIGN, 12, 2)}, {_spans(1, ACCESS, 18, 0)}, {_spans(2, HEX, 16, 0, '[0-9a-f]{16,}').replace(_q(HEX), _q('[0-9a-f]{16,}'))})"
    d = d.withColumn(base_col, F.expr(f"array_sort({light(base)})"))
    level = F.create_map(*[F.lit(x) for kv in cut.items() for x in kv]) if cut else F.create_map().cast("map<int,double>")
    hits = F.filter("_judged", lambda r: r["p"] >= F.try_element_at(level, r["band"]))
    outer = "aggregate(_hits, named_struct('at', 0, 'out', filter(_hits, x -> false)), (s, x) -> IF(x.end <= s.at, s, named_struct('at', x.end, 'out', concat(s.out, array(x))))).out"
    d = d.withColumn("_hits", hits).withColumn("_more", F.expr(outer))
    return d.withColumn(found_col, F.expr(f"array_sort(concat(`{base_col}`, {light('_more')}))")).drop("_t", "_judged", "_hits", "_more")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of its text replaced; overlapping spans are replaced once. Null stays null."""
    d = scan(docs, text_col, base_col="_base", found_col="_found")
    cutout = f"""aggregate(_found, named_struct('at', 0, 'out', ''), (s, x) -> IF(x.end <= s.at, s,
        named_struct('at', x.end, 'out', concat(s.out, IF(x.start >= s.at, concat(substring(`{text_col}`, s.at + 1, x.start - s.at), {_q(mark)}), '')))),
        s -> concat(s.out, substring(`{text_col}`, s.at + 1)))"""
    return d.withColumn(text_col, F.expr(f"IF(size(_found) = 0, `{text_col}`, {cutout})")).drop("_base", "_found")


def _joined(col: str) -> str:
    names = ", ".join(_q(k) for k in KINDS)
    return f"array_join(transform({col}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)), ',')"


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.expr(f"CAST(size(filter(base, x -> x.kind = {k})) AS BIGINT)")
    return d.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined("found")).alias("spans"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
SQL: dict[str, str] = {}
