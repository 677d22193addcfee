"""Voicings of chords and the motion between them, and the measured and perceived color of chords in their key, as SQL.

Relations are named as in theory.py; each step is a common table expression in both dialects.
"""

from __future__ import annotations

from ..functions import chords as C
from .theory import Dialect, rotated

# Ranges of the bass and of the upper voices (MIDI), the widest upper span, and how many voicings of a chord are compared.
BASS, UPPER, SPAN, VOICINGS = (40, 62), (48, 79), 19, 64
# Weights of the interval classes 1, 2 and 6 in dissonance, and the motion at which smoothness is gone.
DISSONANCE, FULL_MOTION = {1: 1.0, 2: 0.4, 6: 0.8}, 24
# Logistic weights of the perceived axes (bias first), over the features of a progression.
PERCEIVED = {
    "nostalgia": (-0.6, {"any_borrowed": 1.6, "has_modal_cadence": 1.0, "mean_brightness01": -0.7, "mean_smoothness": 0.4}),
    "melancholy": (-0.5, {"mean_brightness01": -1.6, "mean_tension": 0.4, "mean_resolution": -0.5, "any_borrowed": 0.5}),
    "warmth": (-0.2, {"mean_brightness01": 0.9, "mean_stability": 0.6, "mean_tension": -0.8, "any_chromatic": -0.3}),
    "dreaminess": (-0.8, {"mean_complexity": 1.3, "has_extension": 0.6, "mean_tension": -0.6, "mean_smoothness": 0.5}),
    "openness": (-0.3, {"mean_resolution": -0.9, "max_finality": -0.7, "has_deceptive": 0.8, "mean_stability": -0.3}),
    "cinematic": (-0.9, {"any_borrowed": 1.1, "has_modal_cadence": 1.2, "mean_chromaticity": 1.0, "mean_tension": 0.5}),
}
# Curated runs of tokens, how sure their color is, and what it is.
CURATED = [
    ("M:iv M:I", 0.85, {"nostalgia": 0.85, "warmth": 0.6, "melancholy": 0.55}),
    ("M:bVI M:bVII M:I", 0.85, {"cinematic": 0.9, "openness": 0.55, "nostalgia": 0.6}),
    ("M:V M:vi", 0.85, {"openness": 0.75, "melancholy": 0.45}),
    ("M:V M:I", 0.8, {"warmth": 0.65, "cinematic": 0.35}),
    ("M:I M:iii", 0.75, {"dreaminess": 0.55, "warmth": 0.55}),
    ("M:Imaj7 M:iii7", 0.8, {"dreaminess": 0.8, "warmth": 0.5}),
    ("M:vi M:IV", 0.75, {"melancholy": 0.45, "nostalgia": 0.4, "warmth": 0.4}),
    ("m:V7 m:i", 0.85, {"melancholy": 0.7, "warmth": 0.3}),
    ("M:bVII M:IV M:I", 0.8, {"cinematic": 0.7, "nostalgia": 0.5}),
    ("M:ii M:V M:I", 0.75, {"warmth": 0.6, "openness": 0.3}),
    ("M:bVI M:V", 0.75, {"cinematic": 0.65, "openness": 0.5}),
    ("M:V7/V M:V", 0.75, {"openness": 0.6, "cinematic": 0.4}),
    ("m:i m:bII", 0.8, {"cinematic": 0.75, "melancholy": 0.5}),
    ("m:bII m:III", 0.7, {"cinematic": 0.55, "dreaminess": 0.4}),
    ("m:iv m:i", 0.75, {"melancholy": 0.6, "warmth": 0.3}),
    ("m:V7 m:VI", 0.75, {"melancholy": 0.55, "openness": 0.6}),
    ("M:I M:bVI", 0.75, {"cinematic": 0.7, "melancholy": 0.35}),
    ("M:I M:III", 0.7, {"cinematic": 0.6, "warmth": 0.4}),
    ("M:ii7 M:V7 M:Imaj7", 0.8, {"warmth": 0.7, "dreaminess": 0.4}),
    ("m:V m:i", 0.8, {"melancholy": 0.65}),
    ("M:iv M:bVII7 M:I", 0.8, {"nostalgia": 0.6, "cinematic": 0.55}),
]
AXES = ("chromaticity", "brightness", "tension", "stability", "smoothness", "complexity", "resolution", "finality")
#: The axes measured with a sequence model.
MEASURED = ("chromaticity", "brightness", "tension", "stability", "surprise", "smoothness", "complexity", "resolution", "finality")
# The least probability that surprise is taken of, and the shares of the cadence and of the model in resolution.
SURPRISE_FLOOR, CADENCE_SHARE, MODEL_SHARE = 1e-06, 0.7, 0.3
# Bases of numerals that are tonic.
TONIC_BASES = ("I", "i", "vi", "VI", "iii", "III")
_MIDI = C.values("midi", "n", [(n,) for n in range(BASS[0], UPPER[1] + 1)])
_KIND = ("quality", "root_pc", "bass_pc")
_NOTES = ("b", "u0", "u1", "u2")


def _d(x: float) -> str:
    """A double literal in both dialects."""
    return f"{x}" if "e" in f"{x}" else f"{x}e0"


def voicings(chords: str = "ch") -> list[str]:
    """vopt: quality, root_pc, bass_pc, b, u0, u1, u2, pcs, idx — the playable four-part voicings of each kind of chord, most usual register first."""
    key, on = ", ".join(_KIND), lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in _KIND)
    mine = lambda a: ", ".join(f"{a}.{k}" for k in _KIND)
    height = "abs(CAST(u0 + u1 + u2 AS DOUBLE) / 3 - 64)"
    usual = f"PARTITION BY {key} ORDER BY abs(b - 48) + {height}, b, u0, u1, u2"
    return [
        _MIDI,
        f"vk AS (SELECT DISTINCT {mine('c')}, q.tones AS nt FROM {chords} c JOIN quality_dim q ON q.quality = c.quality)",
        f"vup AS (SELECT {mine('v')}, v.nt, t.place, m.n FROM vk v JOIN tone_dim t ON t.quality = v.quality JOIN midi m ON m.n >= {UPPER[0]} AND m.n % 12 = (v.root_pc + t.step) % 12)",
        # three different tones; of four or more, the third and the seventh among them; of two, the first twice
        f"""vtri AS (SELECT {mine('a')}, a.n AS u0, b.n AS u1, c.n AS u2 FROM vup a JOIN vup b ON {on('a', 'b')} AND b.n > a.n JOIN vup c ON {on('a', 'c')} AND c.n > b.n AND c.n - a.n <= {SPAN}
  WHERE CASE WHEN a.nt = 2 THEN a.place + b.place + c.place = 1 ELSE a.place <> b.place AND b.place <> c.place AND a.place <> c.place AND (a.nt < 4 OR (1 IN (a.place, b.place, c.place) AND 3 IN (a.place, b.place, c.place))) END)""",
        f"vall AS (SELECT {mine('t')}, m.n AS b, t.u0, t.u1, t.u2, t.u2 - t.u0 <= 12 AS close FROM vtri t JOIN midi m ON m.n <= {BASS[1]} AND m.n % 12 = t.bass_pc AND m.n < t.u0)",
        # of a close voicing, the middle voice can drop by an octave
        f"vset AS (SELECT {key}, b, u0, u1, u2 FROM vall UNION SELECT {key}, b, u1 - 12, u0, u2 FROM vall WHERE close AND u1 - 12 >= {UPPER[0]} AND b < u1 - 12)",
        f"vrank AS (SELECT *, row_number() OVER ({usual}) - 1 AS idx FROM vset)",
        f"vclose AS (SELECT *, row_number() OVER ({usual}) AS r FROM vall WHERE close)",
        f"vroot AS (SELECT {key}, b, u0, u1, u2 FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY abs(b - 48), {height}, b, u0, u1, u2) AS rr FROM vclose WHERE r <= {VOICINGS}) x WHERE rr = 1)",
        f"vboth AS (SELECT {key}, b, u0, u1, u2, idx FROM vrank WHERE idx < {VOICINGS} UNION ALL SELECT {key}, b, u0, u1, u2, {VOICINGS} FROM vroot)",
        f"vone AS (SELECT {key}, b, u0, u1, u2, min(idx) AS idx FROM vboth GROUP BY {key}, b, u0, u1, u2)",
        f"vopt AS (SELECT {mine('v')}, v.b, v.u0, v.u1, v.u2, CAST(v.idx AS BIGINT) AS idx, (1 << CAST(v.b % 12 AS INT)) | (1 << CAST(v.u0 % 12 AS INT)) | (1 << CAST(v.u1 % 12 AS INT)) | (1 << CAST(v.u2 % 12 AS INT)) AS pcs FROM vone v JOIN vroot r ON {on('v', 'r')})",
    ]


def motions(pairs: str = "vpairs") -> list[str]:
    """vlead: the pairs (f_ and t_ quality, root_pc, bass_pc) with total, parallels, widest, common and bass motion of their smoothest voicings.

    Least total motion, then fewest parallel perfects, then least widest motion, then the first voicings; all in one number, whose minimum is taken.
    """
    voices = [("s.b", "t.b"), ("s.u0", "t.u0"), ("s.u1", "t.u1"), ("s.u2", "t.u2")]
    moves = [f"abs({t} - {s})" for s, t in voices]
    total, widest = " + ".join(moves), f"greatest({', '.join(moves)})"
    two = [(a, b) for i, a in enumerate(voices) for b in voices[i + 1 :]]
    parallel = " + ".join(f"CASE WHEN ({b[0]} - {a[0]}) % 12 IN (0, 7) AND ({b[1]} - {a[1]}) % 12 = ({b[0]} - {a[0]}) % 12 AND ({a[1]} - {a[0]}) * ({b[1]} - {b[0]}) > 0 THEN 1 ELSE 0 END" for a, b in two)
    packed = f"(((((CAST({total} AS BIGINT) * 8 + {parallel}) * 128 + {widest}) * 128 + t.idx) * 128 + s.idx) * 8 + bit_count(s.pcs & t.pcs)) * 64 + {moves[0]}"
    keys = ", ".join(f"p.{x}_{k}" for x in "ft" for k in _KIND)
    of = lambda a, x: " AND ".join(f"{a}.{k} = p.{x}_{k}" for k in _KIND)
    return [
        f"vbest AS (SELECT {keys}, min({packed}) AS m FROM {pairs} p JOIN vopt s ON {of('s', 'f')} JOIN vopt t ON {of('t', 't')} GROUP BY {keys})",
        f"vlead AS (SELECT {', '.join(f'{x}_{k}' for x in 'ft' for k in _KIND)}, m >> 33 AS total, (m >> 30) & 7 AS parallels, (m >> 23) & 127 AS widest, (m >> 6) & 7 AS common, m & 63 AS bass FROM vbest)",
    ]


def _pair(a: str, b: str) -> str:
    return ", ".join([*(f"{a}.{k} AS f_{k}" for k in _KIND), *(f"{b}.{k} AS t_{k}" for k in _KIND)])


def _same(lead: str, a: str, b: str) -> str:
    return " AND ".join([*(f"{lead}.f_{k} = {a}.{k}" for k in _KIND), *(f"{lead}.t_{k} = {b}.{k}" for k in _KIND)])


def leading_targets(top: int = 5) -> list[str]:
    """vtop: from_chord, to_chord with both chords' columns — the `top` most frequent playable targets (relation abst) of each playable chord."""
    cols = [*_KIND, "mask", "qclass"]
    return [
        f"cd AS (SELECT DISTINCT canon, {', '.join(cols)} FROM ch)",
        "vplay AS (SELECT DISTINCT c.canon, " + ", ".join(f"c.{x}" for x in cols) + " FROM cd c JOIN vroot r ON " + " AND ".join(f"r.{k} = c.{k}" for k in _KIND) + ")",
        "vnth AS (SELECT a.from_chord, a.to_chord, a.count, row_number() OVER (PARTITION BY a.from_chord ORDER BY a.count DESC, a.to_chord) AS r FROM abst a JOIN vplay f ON f.canon = a.from_chord JOIN vplay t ON t.canon = a.to_chord)",
        f"vtop AS (SELECT from_chord, to_chord FROM vnth WHERE r <= {top})",
        f"vpairs AS (SELECT DISTINCT {_pair('f', 't')} FROM vtop v JOIN vplay f ON f.canon = v.from_chord JOIN vplay t ON t.canon = v.to_chord)",
    ]


LEADING = f"""SELECT v.from_chord, v.to_chord, m.total AS total_motion, m.widest AS max_voice_motion, m.common AS common_tones, m.bass AS bass_motion, m.parallels AS parallel_perfects,
  CASE WHEN bit_count(f.mask) = 3 AND bit_count(t.mask) = 3 AND bit_count(f.mask & t.mask) = 2 AND ((f.qclass = 'maj' AND t.qclass = 'min') OR (f.qclass = 'min' AND t.qclass = 'maj')) THEN
    CASE WHEN t.root_pc = f.root_pc THEN 'P' WHEN (t.root_pc - f.root_pc + 12) % 12 = CASE f.qclass WHEN 'maj' THEN 4 ELSE 8 END THEN 'L' WHEN (t.root_pc - f.root_pc + 12) % 12 = CASE f.qclass WHEN 'maj' THEN 9 ELSE 3 END THEN 'R' END END AS parsimonious
  FROM vtop v JOIN vplay f ON f.canon = v.from_chord JOIN vplay t ON t.canon = v.to_chord JOIN vlead m ON {_same('m', 'f', 't')}"""


def successive(rows: str = "roman") -> list[str]:
    """cseq: rows with idx and the chord before in the section; vpairs: the kinds that follow each other."""
    w = "PARTITION BY song, ordinal ORDER BY pos"
    return [
        f"cseq AS (SELECT *, row_number() OVER ({w}) - 1 AS idx, lag(base) OVER ({w}) AS pbase, {', '.join(f'lag({k}) OVER ({w}) AS p_{k}' for k in _KIND)} FROM {rows})",
        f"vpairs AS (SELECT DISTINCT {', '.join(f'p_{k} AS f_{k}' for k in _KIND)}, {', '.join(f'{k} AS t_{k}' for k in _KIND)} FROM cseq WHERE idx > 0)",
    ]


def color_axes() -> list[str]:
    """color: song, ordinal, idx, token, the measured axes (null where they need a chord before), borrowed, chromatic, extended. Over cseq and vlead."""
    ic = lambda k: f"bit_count(mask & {rotated('mask', str(k))})"
    nt = "bit_count(mask)"
    pairs = f"({nt} * ({nt} - 1) / {_d(2.0)})"
    rough = f"CASE WHEN {nt} < 2 THEN {_d(0.0)} ELSE least({_d(1.0)}, ({_d(1.0)} * {ic(1)} + {_d(DISSONANCE[2])} * {ic(2)} + {_d(DISSONANCE[6])} * {ic(6)} / 2) / {pairs}) END"
    scale = f"CASE mode WHEN 'major' THEN {rotated(str(C.mask(C.SCALES['major'])), 'tonic')} ELSE {rotated(str(C.mask(C.SCALES['minor'])), 'tonic')} END"
    of = "PARTITION BY song, ordinal ORDER BY idx"
    return [
        f"c1 AS (SELECT *, {nt} AS nt, {rough} AS rough, mask & (4095 - ({scale})) AS outside FROM cseq)",
        "clof AS (SELECT x.key_name, x.quality, x.root_pc, avg(CAST(k.lof - t.lof AS DOUBLE)) AS lof FROM (SELECT DISTINCT key_name, tonic, quality, root_pc FROM c1) x JOIN tone_dim d ON d.quality = x.quality JOIN key_pc_dim k ON k.key_name = x.key_name AND k.pc = (x.root_pc + d.step) % 12 JOIN key_pc_dim t ON t.key_name = x.key_name AND t.pc = x.tonic GROUP BY x.key_name, x.quality, x.root_pc)",
        "ext_dim AS (SELECT quality, n_ext FROM quality_ext)",
        f"""c2 AS (SELECT c.song, c.ordinal, c.idx, c.token, c.kind, c.degree, c.acc, c.applied_to, c.inversion, c.nt, c.rough, e.n_ext,
  bit_count(c.outside) / CAST(c.nt AS DOUBLE) AS out_share, bit_count(c.outside & (4095 - coalesce(c.pmask, 0))) / CAST(c.nt AS DOUBLE) AS chromaticity,
  {_d(0.6)} * greatest({_d(-1.0)}, least({_d(1.0)}, l.lof / 7)) + {_d(0.4)} * CASE WHEN c.qclass IN ('maj', 'maj7', 'dom7', 'aug') THEN 1 WHEN c.qclass IN ('sus', 'power') THEN 0 ELSE -1 END AS brightness,
  CASE c.func WHEN 'D' THEN {_d(1.0)} WHEN 'PD' THEN {_d(0.5)} WHEN 'T' THEN {_d(0.0)} ELSE {_d(0.25)} END AS drive, CASE c.func WHEN 'T' THEN {_d(1.0)} WHEN 'PD' THEN {_d(0.5)} WHEN 'D' THEN {_d(0.0)} ELSE {_d(0.25)} END AS rest,
  CASE WHEN c.idx > 0 THEN 1 - least({_d(1.0)}, CAST(m.total AS DOUBLE) / {FULL_MOTION}) END AS smoothness,
  CASE WHEN c.idx = 0 THEN NULL WHEN c.pbase IN ('V', 'vii') AND c.base IN ('I', 'i') THEN {_d(0.95)} WHEN c.pbase = 'IV' AND c.base IN ('I', 'i') THEN {_d(0.75)} WHEN c.pbase = 'V' AND c.base IN ('vi', 'VI', 'bVI') THEN {_d(0.45)} WHEN c.base = 'V' AND c.pbase NOT IN ('V', 'vii') THEN {_d(0.3)} ELSE {_d(0.0)} END AS resolution,
  CASE WHEN c.degree = 1 AND c.acc = '' AND c.applied_to IS NULL AND c.inversion = 'root' THEN 1 ELSE 0 END AS arrival
  FROM c1 c JOIN clof l ON l.key_name = c.key_name AND l.quality = c.quality AND l.root_pc = c.root_pc JOIN ext_dim e ON e.quality = c.quality
  LEFT JOIN vlead m ON {' AND '.join(f'm.f_{k} = c.p_{k} AND m.t_{k} = c.{k}' for k in _KIND)})""",
        f"""color AS (SELECT song, ordinal, idx, token, chromaticity, brightness, {_d(0.4)} * rough + {_d(0.3)} * drive + {_d(0.2)} * out_share + CASE inversion WHEN 'second' THEN {_d(0.1)} ELSE {_d(0.0)} END AS tension,
  (rest + CASE inversion WHEN 'root' THEN 1 ELSE 0 END + (1 - out_share) + (1 - rough)) / {_d(4.0)} AS stability, smoothness, greatest({_d(0.0)}, least({_d(1.0)}, (nt - 3) / {_d(4.0)} + {_d(0.15)} * n_ext)) AS complexity, resolution,
  arrival, resolution * arrival AS finality,
  CASE kind WHEN 'modal_mixture' THEN 1 ELSE 0 END AS borrowed, CASE WHEN kind IN ('chromatic_mediant', 'other') THEN 1 ELSE 0 END AS chromatic, CASE WHEN n_ext > 0 THEN 1 ELSE 0 END AS extended,
  idx = max(idx) OVER (PARTITION BY song, ordinal) AS final FROM c2)""",
    ]


QUALITY_EXT = C.values("quality_ext", "quality, n_ext", [(q, len(C.quality_class(t)[1])) for q, t in C.QUALITIES.items()])


def tonic(token: str = "token") -> str:
    """Is a token's numeral tonic?"""
    return f"regexp_extract(substr({token}, 3), '^[b#]*[ivIV]+', 0) IN ({', '.join(repr(x) for x in TONIC_BASES)})"


def expected_axes() -> list[str]:
    """color9: color with surprise, and resolution and finality as the model sees them; over color and told (song, ordinal, idx, p_token, p_class: that a tonic comes next)."""
    resolution = f"{_d(CADENCE_SHARE)} * c.resolution + {_d(MODEL_SHARE)} * greatest({_d(0.0)}, least({_d(1.0)}, t.p_class))"
    kept = ", ".join(f"c.{a}" for a in MEASURED if a not in ("surprise", "resolution", "finality"))
    return [f"color9 AS (SELECT c.song, c.ordinal, c.idx, c.token, {kept}, -log2(greatest(t.p_token, {_d(SURPRISE_FLOOR)})) AS surprise, {resolution} AS resolution, ({resolution}) * c.arrival AS finality FROM color c JOIN told t ON t.song = c.song AND t.ordinal = c.ordinal AND t.idx = c.idx)"]


def color_norms(d: Dialect, rows: str = "color9", axes: tuple[str, ...] = MEASURED) -> list[str]:
    """norms: axis, subject_type (chord where nothing comes before, else transition), count, percentiles, mean, std."""
    q = ", ".join(f"{d.quantile('v', p)} AS p{round(100 * p):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
    return [
        f"axis_each AS (SELECT CASE WHEN idx = 0 THEN 'chord' ELSE 'transition' END AS subject_type, {d.unpivoted({a: a for a in axes})} AS x FROM {rows})",
        f"norms AS (SELECT axis, subject_type, count(*) AS count, {q}, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std FROM (SELECT subject_type, x.axis AS axis, x.v AS v FROM axis_each) y WHERE v IS NOT NULL GROUP BY axis, subject_type)",
    ]


def normalized(raw: str, norm: str = "n") -> str:
    return f"CASE WHEN {norm}.p95 - {norm}.p05 <= 0 THEN {_d(0.5)} ELSE greatest({_d(0.0)}, least({_d(1.0)}, ({raw} - {norm}.p05) / ({norm}.p95 - {norm}.p05))) END"


def color_arc(d: Dialect, rows: str = "color", facts: str = "facts") -> list[str]:
    """arc: song, ordinal, idx, axis, value, confidence, source: the perceived axes of each section up to every position. A curated run of
    tokens that has occurred is blended with what the features give; of several, the surest."""
    of = "PARTITION BY song, ordinal ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    w = "PARTITION BY song, ordinal ORDER BY idx"
    mean = lambda x, otherwise="0.0e0": f"coalesce(avg({x}) OVER ({of}), {otherwise})"
    axes = list(PERCEIVED)
    value = lambda a: f"1 / (1 + exp(-({_d(PERCEIVED[a][0])} + {' + '.join(f'{_d(x)} * {f}' for f, x in PERCEIVED[a][1].items())})))"
    runs = [(i, *(p.split() + [None])[:3], c) for i, (p, c, _) in enumerate(CURATED)]
    effects = [(i, a, v, c) for i, (_, c, e) in enumerate(CURATED) for a, v in e.items()]
    return [
        C.values("run_dim", "run, t0, t1, t2, sure", runs),
        C.values("effect_dim", "run, axis, v, sure", effects),
        f"fx AS (SELECT song, ordinal, to_index AS idx, max(CASE WHEN rule IN ('minor_plagal', 'aeolian', 'backdoor', 'backdoor_three') THEN 1 ELSE 0 END) AS modal, max(CASE WHEN rule = 'deceptive' THEN 1 ELSE 0 END) AS deceptive FROM {facts} GROUP BY song, ordinal, to_index)",
        f"""feat AS (SELECT c.song, c.ordinal, c.idx, {mean('c.chromaticity')} AS mean_chromaticity, {mean(f'(c.brightness + 1) / 2')} AS mean_brightness01, {mean('c.tension')} AS mean_tension, {mean('c.stability')} AS mean_stability,
  {mean('c.smoothness', '0.5e0')} AS mean_smoothness, {mean('c.complexity')} AS mean_complexity, {mean('c.resolution')} AS mean_resolution, coalesce(max(c.finality) OVER ({of}), {_d(0.0)}) AS max_finality,
  max(c.borrowed) OVER ({of}) AS any_borrowed, max(c.chromatic) OVER ({of}) AS any_chromatic, max(c.extended) OVER ({of}) AS has_extension, max(coalesce(f.modal, 0)) OVER ({of}) AS has_modal_cadence, max(coalesce(f.deceptive, 0)) OVER ({of}) AS has_deceptive
  FROM {rows} c LEFT JOIN fx f USING (song, ordinal, idx))""",
        f"felt0 AS (SELECT song, ordinal, idx, {d.unpivoted({a: value(a) for a in axes})} AS x FROM feat)",
        "felt AS (SELECT song, ordinal, idx, x.axis AS axis, x.v AS derived FROM felt0)",
        f"trip AS (SELECT song, ordinal, idx, token AS a, lead(token) OVER ({w}) AS b, lead(token, 2) OVER ({w}) AS c FROM {rows})",
        "met AS (SELECT t.song, t.ordinal, t.idx + CASE WHEN r.t2 IS NULL THEN 1 ELSE 2 END AS idx, r.run FROM trip t JOIN run_dim r ON r.t0 = t.a AND r.t1 = t.b AND (r.t2 IS NULL OR r.t2 = t.c))",
        # sureness in hundredths, then the first of the runs, in one number
        "metx AS (SELECT m.song, m.ordinal, m.idx, e.axis, max(CAST(round(e.sure * 100) AS INT) * 100 + 99 - m.run) AS best FROM met m JOIN effect_dim e ON e.run = m.run GROUP BY m.song, m.ordinal, m.idx, e.axis)",
        "arc0 AS (SELECT f.song, f.ordinal, f.idx, f.axis, f.derived, max(x.best) OVER (PARTITION BY f.song, f.ordinal, f.axis ORDER BY f.idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM felt f LEFT JOIN metx x ON x.song = f.song AND x.ordinal = f.ordinal AND x.idx = f.idx AND x.axis = f.axis)",
        f"""arc AS (SELECT a.song, a.ordinal, a.idx, a.axis, CASE WHEN e.v IS NULL THEN a.derived ELSE least({_d(1.0)}, greatest({_d(0.0)}, CAST(e.sure AS DOUBLE) * CAST(e.v AS DOUBLE) + (1 - CAST(e.sure AS DOUBLE)) * a.derived)) END AS value,
  coalesce(CAST(e.sure AS DOUBLE), {_d(0.5)} + {_d(0.1)} * least(a.idx, 2)) AS confidence, CASE WHEN e.v IS NULL THEN 'derived' ELSE 'rule' END AS source FROM arc0 a LEFT JOIN effect_dim e ON e.axis = a.axis AND e.run = 99 - a.best % 100)""",
    ]


def wide_arc(rows: str = "color", facts: str = "facts") -> list[str]:
    """arcw: song, ordinal, idx, final and, by axis, what the features give (v_axis) and the surest run that has occurred (b_axis); arc_of() makes the rows of color_arc() of it.

    In Spark's SQL: a position's runs are told by the tokens before it, so one window over a section does for everything, and axes are rows only at the end.
    """
    of = "PARTITION BY song, ordinal ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    w = "PARTITION BY song, ordinal ORDER BY idx"
    mean = lambda x, otherwise="0.0e0": f"coalesce(avg({x}) OVER ({of}), {otherwise})"
    value = lambda a: f"1 / (1 + exp(-({_d(PERCEIVED[a][0])} + {' + '.join(f'{_d(x)} * {f}' for f, x in PERCEIVED[a][1].items())})))"

    def ends(size: int) -> list[tuple]:
        best: dict[str, dict[str, int]] = {}
        for i, (run, sure, effects) in enumerate(CURATED):
            if len(run.split()) == size:
                for a in effects:
                    at = best.setdefault(run, {})
                    at[a] = max(at.get(a, -1), round(sure * 100) * 100 + 99 - i)
        return [(*run.split(), *(x.get(a) for a in PERCEIVED)) for run, x in sorted(best.items())]

    met = lambda a: f"greatest(CAST(r2.{a} AS INT), CAST(r3.{a} AS INT))"
    names = ", ".join(PERCEIVED)
    return [
        C.values("run2", f"t0, t1, {names}", ends(2)), C.values("run3", f"t0, t1, t2, {names}", ends(3)),
        f"fx AS (SELECT song, ordinal, to_index AS idx, max(CASE WHEN rule IN ('minor_plagal', 'aeolian', 'backdoor', 'backdoor_three') THEN 1 ELSE 0 END) AS modal, max(CASE WHEN rule = 'deceptive' THEN 1 ELSE 0 END) AS deceptive FROM {facts} GROUP BY song, ordinal, to_index)",
        f"back AS (SELECT *, lag(token) OVER ({w}) AS t1, lag(token, 2) OVER ({w}) AS t0 FROM {rows})",
        f"ended AS (SELECT c.*, f.modal, f.deceptive, {', '.join(f'{met(a)} AS m_{a}' for a in PERCEIVED)} FROM back c LEFT JOIN run2 r2 ON r2.t0 = c.t1 AND r2.t1 = c.token LEFT JOIN run3 r3 ON r3.t0 = c.t0 AND r3.t1 = c.t1 AND r3.t2 = c.token LEFT JOIN fx f ON f.song = c.song AND f.ordinal = c.ordinal AND f.idx = c.idx)",
        f"""feat AS (SELECT c.song, c.ordinal, c.idx, c.final, {mean('c.chromaticity')} AS mean_chromaticity, {mean(f'(c.brightness + 1) / 2')} AS mean_brightness01, {mean('c.tension')} AS mean_tension, {mean('c.stability')} AS mean_stability,
  {mean('c.smoothness', '0.5e0')} AS mean_smoothness, {mean('c.complexity')} AS mean_complexity, {mean('c.resolution')} AS mean_resolution, coalesce(max(c.finality) OVER ({of}), {_d(0.0)}) AS max_finality,
  max(c.borrowed) OVER ({of}) AS any_borrowed, max(c.chromatic) OVER ({of}) AS any_chromatic, max(c.extended) OVER ({of}) AS has_extension, max(coalesce(c.modal, 0)) OVER ({of}) AS has_modal_cadence, max(coalesce(c.deceptive, 0)) OVER ({of}) AS has_deceptive,
  {', '.join(f'max(c.m_{a}) OVER ({of}) AS b_{a}' for a in PERCEIVED)} FROM ended c)""",
        f"arcw AS (SELECT song, ordinal, idx, final, {', '.join(f'{value(a)} AS v_{a}, b_{a}' for a in PERCEIVED)} FROM feat)",
    ]


def felt(axis: str) -> dict[str, str]:
    """value, confidence and source of an axis over arcw."""
    run, best = f"99 - b_{axis} % 100", f"b_{axis}"
    sure = f"element_at(array({', '.join(_d(float(c)) for _, c, _ in CURATED)}), {run} + 1)"
    effect = f"element_at(array({', '.join(_d(float(e.get(axis, 0.0))) for _, _, e in CURATED)}), {run} + 1)"
    value = f"CASE WHEN {best} IS NULL THEN v_{axis} ELSE least({_d(1.0)}, greatest({_d(0.0)}, {sure} * {effect} + (1 - {sure}) * v_{axis})) END"
    return {"value": value, "confidence": f"CASE WHEN {best} IS NULL THEN {_d(0.5)} + {_d(0.1)} * least(idx, 2) ELSE {sure} END", "source": f"CASE WHEN {best} IS NULL THEN 'derived' ELSE 'rule' END"}


def arc_of(rows: str = "arcw") -> str:
    """Select: song, ordinal, idx, axis, value, confidence, source over arcw."""
    each = ", ".join("named_struct('axis', '" + a + "', " + ", ".join(f"'{k}', {x}" for k, x in felt(a).items()) + ")" for a in PERCEIVED)
    return f"SELECT song, ordinal, idx, x.axis AS axis, x.value AS value, x.confidence AS confidence, x.source AS source FROM (SELECT song, ordinal, idx, explode(array({each})) AS x FROM {rows}) y"


# How much more the last, a borrowed and a chromatic chord weigh in a summary.
FINAL_BONUS, BORROWED_BONUS, CHROMATIC_BONUS = 2.0, 1.5, 1.0


def color_summary(rows: str = "color") -> str:
    """Select: song, ordinal and the weighted mean of each axis, with how many chords drive it."""
    weight = f"(1 + CASE WHEN final THEN {_d(FINAL_BONUS)} ELSE {_d(0.0)} END + CASE WHEN borrowed = 1 THEN {_d(BORROWED_BONUS)} WHEN chromatic = 1 THEN {_d(CHROMATIC_BONUS)} ELSE {_d(0.0)} END)"
    return "SELECT song, ordinal, " + ", ".join(f"round(sum({weight} * {a}) / sum(CASE WHEN {a} IS NOT NULL THEN {weight} END), 9) + 0e0 AS {a}" for a in AXES) + f", sum(borrowed) + sum(chromatic) + 1 AS drivers FROM {rows} GROUP BY song, ordinal"


# Chord qualities by the suffix of a numeral and whether it is upper-case, and the reference keys.
REALIZED = [("", True, "maj"), ("", False, "min"), ("7", True, "7"), ("7", False, "min7"), ("maj7", True, "maj7"), ("maj7", False, "minmaj7"), *[(s, up, q) for s, q in (("o", "dim"), ("o7", "dim7"), ("h7", "min7b5"), ("+", "aug"), ("sus2", "sus2"), ("sus4", "sus4"), ("5", "no3")) for up in (True, False)]]
REALIZED_DIM = C.values("realized_dim", "suffix, upper_case, quality", REALIZED)
REFERENCE_DIM = C.values("reference_dim", "mode, key_name, tonic", [("major", "C major", 0), ("minor", "A minor", 9)])
#: Letters from C on: pitch class and place on the line of fifths; and each pitch class with at most one accidental, a sharp rather than a flat.
LETTER_DIM = C.values("letter_dim", "step, pc, lof", [(i, C.NATURALS[x], C.FIFTHS[x]) for i, x in enumerate("CDEFGAB")])
PLAIN_DIM = C.values("plain_dim", "pc, lof", [(pc, next(C.FIFTHS[x] + 7 * (pc != p) for x, p in C.NATURALS.items() if p in (pc, pc - 1))) for pc in range(12)])


def realized(tokens: str) -> list[str]:
    """token_dim: mode, token, iv (root above the tonic), quality, root_pc, mask and lof (the root's place on the line of fifths, spelled with the letter of its degree) in the reference key. tokens: a relation (mode, token); what can't be realized is absent."""
    return [
        f"tk AS (SELECT DISTINCT mode, token, substr(token, 3) AS body FROM {tokens})",
        "tp AS (SELECT mode, token, CASE WHEN instr(body, '/') > 0 THEN substr(body, 1, instr(body, '/') - 1) ELSE body END AS own, CASE WHEN instr(body, '/') > 0 THEN substr(body, instr(body, '/') + 1) END AS aim FROM tk)",
        """ta AS (SELECT mode, token, coalesce(aim, own) AS num, CASE WHEN aim IS NULL THEN 0 WHEN substr(own, 1, 4) = 'subV' THEN 1 WHEN substr(own, 1, 3) = 'vii' THEN 11 WHEN substr(own, 1, 1) = 'V' THEN 7 END AS up,
  CASE WHEN aim IS NULL THEN regexp_extract(own, '^([b#]?)([IViv]+)(.*)$', 3) WHEN substr(own, 1, 4) = 'subV' THEN substr(own, 5) WHEN substr(own, 1, 3) = 'vii' THEN substr(own, 4) ELSE substr(own, 2) END AS suffix,
  CASE WHEN aim IS NULL THEN regexp_extract(own, '^([b#]?)([IViv]+)', 2) = upper(regexp_extract(own, '^([b#]?)([IViv]+)', 2)) ELSE substr(own, 1, 3) <> 'vii' END AS upper_case FROM tp)""",
        "tn AS (SELECT mode, token, up, suffix, upper_case, regexp_extract(num, '^([b#]?)([IViv]+)', 1) AS acc, upper(regexp_extract(num, '^([b#]?)([IViv]+)', 2)) AS numeral FROM ta)",
        "dg AS (SELECT mode, acc, numeral, min(iv) AS iv, min(degree) AS degree FROM degree_dim GROUP BY mode, acc, numeral)",
        REALIZED_DIM, REFERENCE_DIM, LETTER_DIM, PLAIN_DIM,
        f"""token_dim AS (SELECT t.mode, t.token, (d.iv + t.up) % 12 AS iv, r.quality, (d.iv + t.up + k.tonic) % 12 AS root_pc, {rotated('q.rel_mask', '(d.iv + t.up + k.tonic) % 12')} AS mask,
  CASE WHEN abs((d.iv + t.up + k.tonic - l.pc + 30) % 12 - 6) <= 1 THEN l.lof + 7 * ((d.iv + t.up + k.tonic - l.pc + 30) % 12 - 6) ELSE n.lof END AS lof
  FROM tn t JOIN dg d ON d.mode = t.mode AND d.acc = t.acc AND d.numeral = t.numeral JOIN realized_dim r ON r.suffix = t.suffix AND r.upper_case = t.upper_case JOIN reference_dim k ON k.mode = t.mode JOIN quality_dim q ON q.quality = r.quality
  JOIN letter_dim l ON l.step = (CASE t.mode WHEN 'major' THEN 0 ELSE 5 END + d.degree - 1 + CASE t.up WHEN 7 THEN 4 WHEN 11 THEN 6 ELSE t.up END) % 7 JOIN plain_dim n ON n.pc = (d.iv + t.up + k.tonic) % 12)""",
    ]


def color_drivers(rows: str = "color") -> str:
    """Select: song, ordinal, idx, token, reason, weight: what weighs more in a section's summary. Its last chord, and each borrowed or else chromatic one."""
    return f"""SELECT song, ordinal, idx, token, 'final_cadence' AS reason, {_d(FINAL_BONUS)} AS weight FROM {rows} WHERE final UNION ALL
  SELECT song, ordinal, idx, token, CASE WHEN borrowed = 1 THEN 'borrowed_chord' ELSE 'chromatic_chord' END, CASE WHEN borrowed = 1 THEN {_d(BORROWED_BONUS)} ELSE {_d(CHROMATIC_BONUS)} END FROM {rows} WHERE borrowed = 1 OR chromatic = 1"""


def subjects(patterns: bool = False) -> list[str]:
    """pch, pkeys: functions, transitions between functions of one mode and, if asked, patterns as short progressions in the reference key, one chord each in root position; subj: their supports.

    Over roman, token_dim and, for patterns, rpats (pattern, support) and rspots (pattern, pos, token). Subjects with a token that can't be
    realized, or with tokens of both modes, are in subj alone.
    """
    more = " UNION ALL SELECT 'pattern', pattern, CAST(NULL AS STRING), CAST(NULL AS STRING), support FROM rpats" if patterns else ""
    spots = " UNION ALL SELECT 'pattern', pattern, pos, token FROM rspots" if patterns else ""
    w = "PARTITION BY song, ordinal ORDER BY pos"
    chord = f"q.qclass, q.suffix, q.ext, 'root' AS inversion, t.root_pc, t.root_pc AS bass_pc, t.mask, {rotated('q.core_rel', 't.root_pc')} AS core, t.quality"
    return [
        f"follow AS (SELECT token AS a, lead(token) OVER ({w}) AS b FROM roman)",
        "subj AS (SELECT 'function' AS subject_type, token AS subject_id, token AS a, CAST(NULL AS STRING) AS b, count(*) AS support FROM roman GROUP BY token UNION ALL SELECT 'transition', a || '>' || b, a, b, count(*) FROM follow WHERE b IS NOT NULL AND substr(a, 1, 1) = substr(b, 1, 1) GROUP BY a, b" + more + ")",
        "spos AS (SELECT subject_type, subject_id, 0 AS pos, a AS token FROM subj WHERE a IS NOT NULL UNION ALL SELECT subject_type, subject_id, 1, b FROM subj WHERE b IS NOT NULL" + spots + ")",
        "slen AS (SELECT subject_type, subject_id, count(*) AS n FROM spos WHERE token IS NOT NULL GROUP BY subject_type, subject_id)",
        f"pch0 AS (SELECT s.subject_type, s.subject_id, s.pos, t.mode, {chord} FROM spos s JOIN token_dim t ON t.token = s.token JOIN quality_dim q ON q.quality = t.quality)",
        "whole AS (SELECT p.subject_type, p.subject_id FROM pch0 p JOIN slen s ON s.subject_type = p.subject_type AND s.subject_id = p.subject_id GROUP BY p.subject_type, p.subject_id HAVING count(*) = max(s.n) AND count(DISTINCT p.mode) = 1)",
        "pch AS (SELECT p.subject_type || ' ' || p.subject_id AS song, 0 AS ordinal, p.pos, p.mode AS key_mode, p.qclass, p.suffix, p.ext, p.inversion, p.root_pc, p.bass_pc, p.mask, p.core, p.quality FROM pch0 p JOIN whole w ON w.subject_type = p.subject_type AND w.subject_id = p.subject_id)",
        "pkeys AS (SELECT DISTINCT c.song, c.ordinal, k.key_name, k.tonic, k.mode, CAST(1 AS DOUBLE) AS p FROM pch c JOIN reference_dim k ON k.mode = c.key_mode)",
    ]
