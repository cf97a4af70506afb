"""Scalar functions as SQL function bodies, which Catalyst inlines and compiles.

Each entry is ``name: (parameters, return type, body)``.  Names that Spark has
with another meaning are registered with the prefix ``q_``; see ``register``.
"""

from __future__ import annotations

from . import fulltext

_TS = "timestamp"
#: Microseconds of a unit that DATEDIFF counts; a month is 30 days and a year 365.
_UNIT = """CASE rtrim('S', upper(unit)) WHEN 'SECOND' THEN 1000000L WHEN 'MINUTE' THEN 60000000L WHEN 'HOUR' THEN 3600000000L WHEN 'DAY' THEN 86400000000L
 WHEN 'WEEK' THEN 604800000000L WHEN 'MONTH' THEN 2592000000000L WHEN 'YEAR' THEN 31536000000000L ELSE raise_error(concat('unknown unit ', unit)) END"""
#: Months are counted on without cutting a day that the new month lacks: Jan 31 + 1 month is in March.
_MONTHS = "timestampadd(MICROSECOND, unix_micros(d) - unix_micros(date_trunc('MONTH', d)), CAST(add_months(trunc(CAST(d AS DATE), 'MM'), n) AS TIMESTAMP))"
_ADD = f"""CASE rtrim('S', upper(unit)) WHEN 'SECOND' THEN timestampadd(SECOND, CAST(n AS INT), d) WHEN 'MINUTE' THEN timestampadd(MINUTE, CAST(n AS INT), d)
 WHEN 'HOUR' THEN timestampadd(HOUR, CAST(n AS INT), d) WHEN 'DAY' THEN timestampadd(DAY, CAST(n AS INT), d) WHEN 'WEEK' THEN timestampadd(DAY, CAST(n * 7 AS INT), d)
 WHEN 'MONTH' THEN {_MONTHS.replace(", n)", ", CAST(n AS INT))")} WHEN 'QUARTER' THEN {_MONTHS.replace(", n)", ", CAST(3 * n AS INT))")}
 WHEN 'YEAR' THEN {_MONTHS.replace(", n)", ", CAST(12 * n AS INT))")} ELSE raise_error(concat('unknown unit ', unit)) END"""
_STEMMED = "CASE " + " ".join(f"WHEN w LIKE '%{x}' AND length(w) > {len(x) + 3} THEN left(w, length(w) - {len(x)})" for x in fulltext.SUFFIXES) + " ELSE w END"
_STOPS = ", ".join(f"'{x}'" for x in fulltext.STOP)
#: Words that become tokens, to be counted without listing them.
_COUNTED = f"(?<![A-Za-z0-9])(?!(?i:{'|'.join(x for x in fulltext.STOP if len(x) > 1)})(?![A-Za-z0-9]))[A-Za-z0-9]{{2,}}"
_TOKENS = f"transform(filter(transform(regexp_extract_all(t, '[A-Za-z0-9]+', 0), w -> lower(w)), w -> length(w) > 1 AND NOT array_contains(array({_STOPS}), w)), w -> {_STEMMED})"
_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_SQ = "aggregate({v}, 0D, (s, x) -> s + x * x)"
_SAME = "CASE WHEN size(a) <> size(b) THEN raise_error('vectors differ in dimension') ELSE {e} END"
_COS = f"({_DOT}) / CASE WHEN {_SQ.format(v='a')} = 0 OR {_SQ.format(v='b')} = 0 THEN raise_error('a zero vector has no direction') ELSE sqrt({_SQ.format(v='a')}) * sqrt({_SQ.format(v='b')}) END"
_HAV = "2 * 6371000 * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"
_LON = "CAST(get_json_object({p}, '$.coordinates[0]') AS DOUBLE)"
_LAT = "CAST(get_json_object({p}, '$.coordinates[1]') AS DOUBLE)"
_PT = "to_json(named_struct('type', 'Point', 'coordinates', array({lon}, {lat})))"
_P2 = {"lat1": _LAT.format(p="p"), "lon1": _LON.format(p="p"), "lat2": _LAT.format(p="q"), "lon2": _LON.format(p="q")}


def _points(expr: str) -> str:
    for k, v in _P2.items():
        expr = expr.replace(k, v)
    return expr


#: All first (1) or second (2) numbers of the positions of a geometry, or of a feature's geometry.
_AXIS = "transform(regexp_extract_all(coalesce(get_json_object(g, '$.geometry'), g), '\\\\[\\\\s*(-?[0-9][0-9.eE+-]*)\\\\s*,\\\\s*(-?[0-9][0-9.eE+-]*)', {k}), x -> CAST(x AS DOUBLE))"
_BOX = f"CASE WHEN size({_AXIS.format(k=1)}) > 0 THEN array(array_min({_AXIS.format(k=1)}), array_min({_AXIS.format(k=2)}), array_max({_AXIS.format(k=1)}), array_max({_AXIS.format(k=2)})) END"
_RING = "concat('{{\"type\":\"Polygon\",\"coordinates\":[[[', {w}, ',', {s}, '],[', {e}, ',', {s}, '],[', {e}, ',', {n}, '],[', {w}, ',', {n}, '],[', {w}, ',', {s}, ']]]}}')"
_TX = "CAST(floor(pmod(lon + 180, 360D) / 360 * pow(2, z)) AS BIGINT)"
_CLAMP = "radians(greatest(-85.05112878D, least(85.05112878D, lat)))"
_TY = f"CAST(greatest(0D, least(pow(2, z) - 1, floor((1 - ln(tan({_CLAMP}) + 1 / cos({_CLAMP})) / pi()) / 2 * pow(2, z)))) AS BIGINT)"
_TLAT = "degrees(atan(sinh(pi() * (1 - 2 * {y} / pow(2, z)))))"
_BEAR = "pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))), 360D)"
_DLAT = f"asin(sin(radians({_LAT.format(p='p')})) * cos(m / 6371000D) + cos(radians({_LAT.format(p='p')})) * sin(m / 6371000D) * cos(radians(bearing)))"
_DLON = f"radians({_LON.format(p='p')}) + atan2(sin(radians(bearing)) * sin(m / 6371000D) * cos(radians({_LAT.format(p='p')})), cos(m / 6371000D) - sin(radians({_LAT.format(p='p')})) * sin({_DLAT}))"
_BX = _points("cos(radians(lat2)) * cos(radians(lon2 - lon1))")
_BY = _points("cos(radians(lat2)) * sin(radians(lon2 - lon1))")
_MLAT = _points(f"degrees(atan2(sin(radians(lat1)) + sin(radians(lat2)), sqrt(pow(cos(radians(lat1)) + {_BX}, 2) + pow({_BY}, 2))))")
_MLON = _points(f"lon1 + degrees(atan2({_BY}, cos(radians(lat1)) + {_BX}))")
_RECENCY = "CASE WHEN ts IS NULL OR half_life IS NULL THEN NULL WHEN half_life <= 0 THEN raise_error('the half-life must be positive') ELSE least(1D, greatest(0D, exp(-ln(2D) * greatest(0D, (unix_micros(coalesce(now, current_timestamp())) - unix_micros(ts)) / 8.64E10) / half_life))) END"
_BLOB = "CASE WHEN length(b) % 2 = 0 AND b RLIKE '^[0-9A-Fa-f]*$' THEN unhex(b) ELSE CAST(b AS BINARY) END"
_BYTE = "coalesce(CAST(conv(substring(bm, 2 * CAST(bit DIV 8 AS INT) + 1, 2), 16, 10) AS INT), 0)"
_DOM = "CASE WHEN {bad} THEN raise_error('{name}: argument out of range') ELSE {e} END"

S, D, I, B, L = "STRING", "DOUBLE", "INT", "BOOLEAN", "BIGINT"  # noqa: E741
V, A = "ARRAY<DOUBLE>", "ARRAY<STRING>"

DEFINITIONS: dict[str, tuple[str, str, str]] = {
    # strings
    "trim": (f"s {S}, cut {S} DEFAULT NULL", S, "CASE WHEN cut IS NULL THEN regexp_replace(s, '^[\\\\s\\\\u0085\\\\u00A0]+|[\\\\s\\\\u0085\\\\u00A0]+$', '') ELSE btrim(s, cut) END"),
    "ltrim": (f"s {S}, cut {S} DEFAULT NULL", S, "CASE WHEN cut IS NULL THEN regexp_replace(s, '^[\\\\s\\\\u0085\\\\u00A0]+', '') ELSE ltrim(cut, s) END"),
    "rtrim": (f"s {S}, cut {S} DEFAULT NULL", S, "CASE WHEN cut IS NULL THEN regexp_replace(s, '[\\\\s\\\\u0085\\\\u00A0]+$', '') ELSE rtrim(cut, s) END"),
    "substring": (f"s {S}, start {I}, len {I} DEFAULT 2147483647", S, "substring(s, CASE WHEN start < 0 AND -start > char_length(s) THEN 1 WHEN start = 0 THEN 1 ELSE start END, len)"),
    "left": (f"s {S}, n {I}", S, "CASE WHEN n < 0 THEN '' ELSE left(s, n) END"),
    "right": (f"s {S}, n {I}", S, "CASE WHEN n < 0 THEN '' ELSE right(s, n) END"),
    "space": (f"n {I}", S, "repeat(' ', greatest(n, 0))"),
    "ascii": (f"s {S}", I, "CASE WHEN s = '' THEN 0 ELSE CAST(conv(left(hex(s), 2), 16, 10) AS INT) END"),
    "char": (f"n {I}", S, "CASE WHEN n BETWEEN 0 AND 127 THEN chr(n) ELSE '' END"),
    "initcap": (f"s {S}", S, "initcap(btrim(regexp_replace(s, '\\\\s+', ' ')))"),
    "split_part": (f"s {S}, delim {S}, n {I}", S, "CASE WHEN n < 1 THEN '' WHEN delim = '' THEN if(n = 1, s, '') ELSE split_part(s, delim, n) END"),
    "soundex": (f"s {S}", S, "CASE WHEN s RLIKE '[A-Za-z]' THEN rpad(concat(upper(left(regexp_replace(s, '[^A-Za-z]', ''), 1)), left(regexp_replace(substring(regexp_replace(translate(lower(regexp_replace(s, '[^A-Za-z]', '')), 'bfpvcgjkqsxzdtlmnraeiouyhw', '11112222222233455600000000'), '([0-9])\\\\1+', '$1'), 2), '0', ''), 3)), 4, '0') ELSE '' END"),
    "contains": (f"s {S}, sub {S}", B, "coalesce(contains(s, sub), false)"),
    "starts_with": (f"s {S}, p {S}", B, "coalesce(startswith(s, p), false)"),
    "ends_with": (f"s {S}, p {S}", B, "coalesce(endswith(s, p), false)"),
    "regexp_match": (f"s {S}, p {S}", B, "coalesce(s RLIKE p, false)"),
    "regexp_extract": (f"s {S}, p {S}", S, "CASE WHEN s RLIKE p THEN regexp_extract(s, p, 0) END"),
    "edit_distance": (f"a {S}, b {S}", I, "levenshtein(a, b)"),
    "text_word_count": (f"s {S}", I, "size(filter(split(s, '\\\\s+'), x -> x <> ''))"),
    "text_char_count": (f"s {S}", I, "char_length(s)"),
    "text_truncate": (f"s {S}, most {I}, tail {S} DEFAULT '...'", S, "CASE WHEN char_length(s) > most THEN concat(left(s, greatest(most - char_length(tail), 0)), left(tail, greatest(most, 0))) ELSE s END"),
    "quote": (f"v {S}", S, "coalesce(concat('\\'', replace(v, '\\'', '\\'\\''), '\\''), 'NULL')"),
    # hashes and encodings
    "hex": (f"v {S}", S, "hex(v)"),
    "unhex": (f"s {S}", S, "CAST(unhex(if(length(s) % 2 = 1, concat('0', s), s)) AS STRING)"),
    "sha256": (f"s {S}", S, "sha2(s, 256)"),
    "sha512": (f"s {S}", S, "sha2(s, 512)"),
    "base64_encode": (f"s {S}", S, "base64(CAST(s AS BINARY))"),
    "base64_decode": (f"s {S}", S, "CAST(unbase64(s) AS STRING)"),
    # numbers, always double
    "abs": (f"x {D}", D, "abs(x)"),
    "round": (f"x {D}, d {I} DEFAULT 0", D, "signum(x) * floor(abs(x) * pow(10, d) + 0.5D) / pow(10, d)"),
    "floor": (f"x {D}", D, "CAST(floor(x) AS DOUBLE)"),
    "ceil": (f"x {D}", D, "CAST(ceil(x) AS DOUBLE)"),
    "truncate": (f"x {D}, d {I} DEFAULT 0", D, "signum(x) * floor(abs(x) * pow(10, d)) / pow(10, d)"),
    "mod": (f"a {D}, b {D}", D, "a % b"),
    "sqrt": (f"x {D}", D, _DOM.format(bad="x < 0", name="SQRT", e="sqrt(x)")),
    "ln": (f"x {D}", D, _DOM.format(bad="x <= 0", name="LN", e="ln(x)")),
    "log10": (f"x {D}", D, _DOM.format(bad="x <= 0", name="LOG10", e="log10(x)")),
    "log2": (f"x {D}", D, _DOM.format(bad="x <= 0", name="LOG2", e="log2(x)")),
    "log": (f"a {D}, b {D} DEFAULT NULL", D, "CASE WHEN a <= 0 OR b <= 0 THEN raise_error('LOG: argument out of range') WHEN b IS NULL THEN ln(a) ELSE log(a, b) END"),
    "sign": (f"x {D}", I, "CAST(signum(x) AS INT)"),
    "asin": (f"x {D}", D, _DOM.format(bad="abs(x) > 1", name="ASIN", e="asin(x)")),
    "acos": (f"x {D}", D, _DOM.format(bad="abs(x) > 1", name="ACOS", e="acos(x)")),
    # dates
    "current_time": ("", S, "date_format(current_timestamp(), 'HH:mm:ss')"),
    "from_timestamp": (f"secs {D}", _TS, "timestamp_micros(CAST(secs * 1000000 AS BIGINT))"),
    "timestamp": (f"t {_TS}", L, "unix_seconds(t)"),
    "datediff": (f"unit {S}, a {_TS}, b {_TS}", L, f"CAST((unix_micros(b) - unix_micros(a)) DIV {_UNIT} AS BIGINT)"),
    "date_add": (f"d {_TS}, n {D}, unit {S} DEFAULT 'DAY'", _TS, _ADD),
    "date_sub": (f"d {_TS}, n {D}, unit {S} DEFAULT 'DAY'", _TS, f"q_date_add(d, -n, unit)"),
    "add_months": (f"d {_TS}, n {I}", _TS, _MONTHS),
    "eomonth": (f"d {_TS}, n {I} DEFAULT 0", "DATE", f"last_day(CAST({_MONTHS} AS DATE))"),
    "extract_part": (f"part {S}, t {_TS}", D, "CASE upper(part) WHEN 'YEAR' THEN year(t) WHEN 'QUARTER' THEN quarter(t) WHEN 'MONTH' THEN month(t) WHEN 'WEEK' THEN weekofyear(t) WHEN 'DAY' THEN day(t) WHEN 'DOW' THEN dayofweek(t) - 1 WHEN 'DOY' THEN dayofyear(t) WHEN 'HOUR' THEN hour(t) WHEN 'MINUTE' THEN minute(t) WHEN 'SECOND' THEN second(t) WHEN 'EPOCH' THEN unix_seconds(t) ELSE raise_error(concat('unknown part ', part)) END"),
    "strftime": (f"f {S}, t {_TS} DEFAULT current_timestamp()", S, "replace(" + "".join("replace(" for _ in range(10)) + "replace(f, '%%', '\\u0001')" + ", '%Y', date_format(t, 'yyyy')), '%m', date_format(t, 'MM')), '%d', date_format(t, 'dd')), '%H', date_format(t, 'HH')), '%M', date_format(t, 'mm')), '%S', date_format(t, 'ss')), '%j', lpad(dayofyear(t), 3, '0')), '%W', lpad(CAST(floor((dayofyear(t) + 6 - pmod(dayofweek(t) + 5, 7)) / 7) AS STRING), 2, '0')), '%w', dayofweek(t) - 1), '%s', unix_seconds(t)), '\\u0001', '%')"),
    "date": (f"t {_TS} DEFAULT current_timestamp()", S, "date_format(t, 'yyyy-MM-dd')"),
    "time": (f"t {_TS} DEFAULT current_timestamp()", S, "date_format(t, 'HH:mm:ss')"),
    "datetime": (f"t {_TS} DEFAULT current_timestamp()", S, "date_format(t, 'yyyy-MM-dd HH:mm:ss')"),
    "julianday": (f"t {_TS} DEFAULT current_timestamp()", D, "unix_micros(t) / 86400e6 + 2440587.5D"),
    "unixepoch": (f"t {_TS} DEFAULT current_timestamp()", L, "unix_seconds(t)"),
    "overlaps": (f"s1 {_TS}, e1 {_TS}, s2 {_TS}, e2 {_TS}", B, "CASE WHEN e1 < s1 OR e2 < s2 THEN raise_error('OVERLAPS: a range ends before it starts') WHEN s1 = e1 AND s2 = e2 THEN false WHEN s1 = e1 THEN s1 >= s2 AND s1 < e2 WHEN s2 = e2 THEN s2 >= s1 AND s2 < e1 ELSE s1 < e2 AND s2 < e1 END"),
    "in_period": (f"period {S}, t {_TS}, now {_TS} DEFAULT current_timestamp()", B, """CASE upper(period) WHEN 'TODAY' THEN CAST(t AS DATE) = CAST(now AS DATE)
 WHEN 'YTD' THEN t >= date_trunc('YEAR', now) AND t <= now WHEN 'MTD' THEN t >= date_trunc('MONTH', now) AND t <= now WHEN 'QTD' THEN t >= date_trunc('QUARTER', now) AND t <= now
 WHEN 'L12M' THEN t >= add_months(date_trunc('MONTH', now), -12) AND t < now WHEN 'PREVIOUS_12_MONTHS' THEN t >= add_months(date_trunc('MONTH', now), -12) AND t < date_trunc('MONTH', now)
 WHEN 'CURRENT_QUARTER' THEN date_trunc('QUARTER', t) = date_trunc('QUARTER', now) WHEN 'PREVIOUS_QUARTER' THEN date_trunc('QUARTER', t) = CAST(add_months(date_trunc('QUARTER', now), -3) AS TIMESTAMP)
 WHEN 'NEXT_QUARTER' THEN date_trunc('QUARTER', t) = CAST(add_months(date_trunc('QUARTER', now), 3) AS TIMESTAMP) WHEN 'CURRENT_YEAR_FULL' THEN year(t) = year(now) WHEN 'LAST_YEAR_FULL' THEN year(t) = year(now) - 1
 ELSE raise_error(concat('unknown period ', period)) END"""),
    "range_merge": (f"r ARRAY<ARRAY<{D}>>", f"ARRAY<ARRAY<{D}>>", f"aggregate(array_sort(r), CAST(array() AS ARRAY<ARRAY<{D}>>), (acc, x) -> CASE WHEN size(acc) > 0 AND element_at(acc, -1)[1] >= x[0] THEN concat(slice(acc, 1, size(acc) - 1), array(array(element_at(acc, -1)[0], greatest(element_at(acc, -1)[1], x[1])))) ELSE concat(acc, array(x)) END)"),
    # arrays
    "split": (f"s {S}, delim {S}", A, "split(s, concat('\\\\Q', delim, '\\\\E'))"),
    "first": (f"a {A}", S, "get(a, 0)"),
    "last": (f"a {A}", S, "get(a, size(a) - 1)"),
    "array_length": (f"a {A}", I, "CASE WHEN a IS NULL THEN 0 ELSE size(a) END"),
    "array_contains": (f"a {A}, v {S}", B, "coalesce(array_contains(a, v), false)"),
    "array_join": (f"a {A}, sep {S} DEFAULT ','", S, "array_join(a, sep)"),
    # bitmaps as hexadecimal text, bit n in byte n / 8
    "bitmap_new": ("", S, "''"),
    "bitmap_get": (f"bm {S}, bit {I}", B, f"coalesce(bit >= 0 AND bit < 4 * length(bm) AND ({_BYTE} & shiftleft(1, pmod(bit, 8))) <> 0, false)"),
    "bitmap_set": (f"bm {S}, bit {I}", S, f"CASE WHEN bit < 0 OR bit > 1023 THEN raise_error('BITMAP_SET: bit out of range') ELSE concat(left(rpad(bm, greatest(length(bm), 2 * CAST(bit DIV 8 AS INT)), '0'), 2 * CAST(bit DIV 8 AS INT)), lower(lpad(hex({_BYTE} | shiftleft(1, bit % 8)), 2, '0')), substring(bm, 2 * CAST(bit DIV 8 AS INT) + 3)) END"),
    "bitmap_count_hex": (f"bm {S}", L, "aggregate(sequence(1, greatest(length(bm), 1)), 0L, (n, k) -> n + bit_count(CAST(conv(coalesce(nullif(substring(bm, k, 1), ''), '0'), 16, 10) AS INT)))"),
    "bitmap_or": (f"a {S}, b {S}", S, "regexp_replace(lower(array_join(transform(sequence(1, greatest(length(a), length(b), 2), 2), k -> lpad(hex(coalesce(CAST(conv(nullif(substring(a, k, 2), ''), 16, 10) AS INT), 0) | coalesce(CAST(conv(nullif(substring(b, k, 2), ''), 16, 10) AS INT), 0)), 2, '0')), '')), '(00)+$', '')"),
    "bitmap_and": (f"a {S}, b {S}", S, "regexp_replace(lower(array_join(transform(sequence(1, greatest(length(a), length(b), 2), 2), k -> lpad(hex(coalesce(CAST(conv(nullif(substring(a, k, 2), ''), 16, 10) AS INT), 0) & coalesce(CAST(conv(nullif(substring(b, k, 2), ''), 16, 10) AS INT), 0)), 2, '0')), '')), '(00)+$', '')"),
    "blob_length": (f"b {S}", I, f"octet_length({_BLOB})"),
    "blob_hex": (f"b {S}", S, f"lower(hex({_BLOB}))"),
    "blob_from_hex": (f"s {S}", "BINARY", "unhex(s)"),
    "blob_substr": (f"b {S}, start {I}, len {I}", S, f"lower(hex(substring({_BLOB}, start + 1, len)))"),
    "blob_concat": (f"b {S}, c {S}", S, f"lower(hex(concat({_BLOB}, {_BLOB.replace('b)', 'c)').replace('b RLIKE', 'c RLIKE').replace('(b AS', '(c AS')})))"),
    "blob_to_base64": (f"b {S}", S, f"base64({_BLOB})"),
    "blob_from_base64": (f"s {S}", "BINARY", "unbase64(s)"),
    "blob_equal": (f"b {S}, c {S}", B, f"{_BLOB} = {_BLOB.replace('b)', 'c)').replace('b RLIKE', 'c RLIKE').replace('(b AS', '(c AS')}"),
    # JSON, YAML, addresses
    "json_get": (f"j {S}, path {S}", S, "get_json_object(j, concat('$', regexp_replace(concat('.', path), '\\\\.([0-9]+)(?=\\\\.|$)', '[$1]')))"),
    "json_extract": (f"j {S}, path {S}", S, "get_json_object(j, concat('$', regexp_replace(concat('.', path), '\\\\.([0-9]+)(?=\\\\.|$)', '[$1]')))"),
    "yaml_parse": (f"y {S}", S, "CASE WHEN btrim(y) = '' THEN raise_error('YAML_PARSE: empty text') ELSE btrim(y) END"),
    "yaml_get": (f"y {S}, k {S}", S, "nullif(btrim(btrim(regexp_extract(y, concat('(?im)^\\\\Q', k, '\\\\E:[ \\\\t]*(.*)$'), 1)), '\"\\''), '')"),
    "url_parse": (f"u {S}", S, "to_json(named_struct('scheme', coalesce(parse_url(u, 'PROTOCOL'), ''), 'host', coalesce(parse_url(u, 'HOST'), ''), 'path', coalesce(parse_url(u, 'PATH'), ''), 'query', coalesce(parse_url(u, 'QUERY'), ''), 'fragment', coalesce(parse_url(u, 'REF'), '')))"),
    # full text
    "fts_tokens": (f"t {S}", A, _TOKENS),
    "fts_word_count": (f"t {S}", I, f"regexp_count(t, '{_COUNTED}')"),
    # vectors
    "vec_from_json": (f"s {S}", V, "from_json(s, 'array<double>')"),
    "vec_to_json": (f"v {V}", S, "to_json(v)"),
    "vec_dim": (f"v {V}", I, "size(v)"),
    "vec_norm": (f"v {V}", D, f"sqrt({_SQ.format(v='v')})"),
    "vec_normalize": (f"v {V}", V, f"CASE WHEN {_SQ.format(v='v')} = 0 THEN raise_error('a zero vector has no direction') ELSE transform(v, x -> x / sqrt({_SQ.format(v='v')})) END"),
    "vec_add": (f"a {V}, b {V}", V, _SAME.format(e="zip_with(a, b, (x, y) -> x + y)")),
    "vec_sub": (f"a {V}, b {V}", V, _SAME.format(e="zip_with(a, b, (x, y) -> x - y)")),
    "vec_mul": (f"a {V}, b {V}", V, _SAME.format(e="zip_with(a, b, (x, y) -> x * y)")),
    "vec_scale": (f"v {V}, k {D}", V, "transform(v, x -> x * k)"),
    "vec_dot": (f"a {V}, b {V}", D, _SAME.format(e=_DOT)),
    "vec_cosine_similarity": (f"a {V}, b {V}", D, _SAME.format(e=_COS)),
    "vec_cosine_distance": (f"a {V}, b {V}", D, _SAME.format(e=f"1 - {_COS}")),
    "vec_l2_distance": (f"a {V}, b {V}", D, _SAME.format(e="sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")),
    "vec_manhattan_distance": (f"a {V}, b {V}", D, _SAME.format(e="aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)")),
    "vec_distance": (f"a {V}, b {V}, metric {S} DEFAULT 'cosine'", D, f"CASE lower(metric) WHEN 'cosine' THEN 1 - {_COS} WHEN 'l2' THEN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)) WHEN 'euclidean' THEN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)) WHEN 'manhattan' THEN aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x) WHEN 'l1' THEN aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x) WHEN 'dot' THEN -({_DOT}) ELSE raise_error(concat('unknown metric ', metric)) END"),
    "vec_hamming_distance": (f"a {V}, b {V}", I, _SAME.format(e="aggregate(zip_with(a, b, (x, y) -> CAST((x > 0) <> (y > 0) AS INT)), 0, (s, x) -> s + x)")),
    "vec_slice": (f"v {V}, start {I}, len {I}", V, "slice(v, start + 1, len)"),
    "vec_concat": (f"a {V}, b {V}", V, "concat(a, b)"),
    "vec_quantize": (f"v {V}, bits {I}", V, "CASE WHEN bits NOT IN (8, 16) THEN raise_error('VEC_QUANTIZE: 8 or 16 bits') WHEN array_max(v) = array_min(v) THEN v ELSE transform(v, x -> round((x - array_min(v)) / (array_max(v) - array_min(v)) * (pow(2, bits) - 1)) / (pow(2, bits) - 1) * (array_max(v) - array_min(v)) + array_min(v)) END"),
    "vec_binary_quantize": (f"v {V}", V, "transform(v, x -> CASE WHEN x > 0 THEN 1D ELSE 0D END)"),
    "vec_avg": (f"a {V}, b {V}", V, _SAME.format(e="zip_with(a, b, (x, y) -> (x + y) / 2)")),
    "recency_score": (f"ts {_TS}, half_life {D}, now {_TS} DEFAULT NULL", D, _RECENCY),
    "rag_hybrid_score": (f"sim {D}, ts {_TS}, half_life {D}, w {D} DEFAULT 0.7, now {_TS} DEFAULT NULL", D, f"w * (sim + 1) / 2 + (1 - w) * {_RECENCY}"),
    "rag_rank_score": (f"sim {D}, ts {_TS}, half_life {D}, quality {D}, w1 {D} DEFAULT 0.65, w2 {D} DEFAULT 0.25, w3 {D} DEFAULT 0.10, now {_TS} DEFAULT NULL", D, f"(w1 * (sim + 1) / 2 + w2 * {_RECENCY} + w3 * quality) / (w1 + w2 + w3)"),
    # points
    "geo_point": (f"lon {D}, lat {D}", S, _PT.format(lon="lon", lat="lat")),
    "geo_lon": (f"p {S}", D, _LON.format(p="p")),
    "geo_lat": (f"p {S}", D, _LAT.format(p="p")),
    "haversine": (f"lat1 {D}, lon1 {D}, lat2 {D}, lon2 {D}", D, _HAV),
    "geo_distance": (f"p {S}, q {S}", D, _points(_HAV)),
    "geo_dwithin": (f"p {S}, q {S}, m {D}", B, f"{_points(_HAV)} <= m"),
    "geo_within_bbox": (f"p {S}, w {D}, s {D}, e {D}, n {D}", B, f"{_LON.format(p='p')} BETWEEN w AND e AND {_LAT.format(p='p')} BETWEEN s AND n"),
    "geo_bearing": (f"p {S}, q {S}", D, _points(_BEAR)),
    "geo_destination": (f"p {S}, bearing {D}, m {D}", S, _PT.format(lon=f"pmod(degrees({_DLON}) + 540, 360D) - 180", lat=f"degrees({_DLAT})")),
    "geo_midpoint": (f"p {S}, q {S}", S, _PT.format(lon=f"pmod({_MLON} + 540, 360D) - 180", lat=_MLAT)),
    "geo_bbox": (f"g {S}", "ARRAY<DOUBLE>", _BOX),
    "geo_envelope": (f"g {S}", S, "transform(array(" + _BOX + "), b -> " + _RING.format(w="b[0]", s="b[1]", e="b[2]", n="b[3]") + ")[0]"),
    # map tiles
    "tile_x": (f"lon {D}, z {I}", L, _TX),
    "tile_y": (f"lat {D}, z {I}", L, _TY),
    "tile_zxy": (f"lon {D}, lat {D}, z {I}", S, f"to_json(named_struct('z', z, 'x', {_TX}, 'y', {_TY}, 'tms_y', CAST(pow(2, z) AS BIGINT) - 1 - {_TY}))"),
    "tile_flip_y": (f"y {L}, z {I}", L, "CAST(pow(2, z) AS BIGINT) - 1 - y"),
    "tile_lon": (f"x {D}, z {I}", D, "x / pow(2, z) * 360 - 180"),
    "tile_lat": (f"y {D}, z {I}", D, _TLAT.format(y="y")),
    "tile_bbox": (f"z {I}, x {L}, y {L}", S, f"to_json(array(x / pow(2, z) * 360 - 180, {_TLAT.format(y='(y + 1)')}, (x + 1) / pow(2, z) * 360 - 180, {_TLAT.format(y='y')}))"),
    "tile_quadkey": (f"z {I}, x {L}, y {L}", S, "CASE WHEN z = 0 THEN '' ELSE array_join(transform(sequence(z - 1, 0, -1), k -> CAST((shiftright(x, k) & 1) + 2 * (shiftright(y, k) & 1) AS STRING)), '') END"),
    "tile_from_quadkey": (f"q {S}", S, "to_json(aggregate(filter(split(q, ''), c -> c <> ''), named_struct('z', 0, 'x', 0L, 'y', 0L), (a, c) -> named_struct('z', a.z + 1, 'x', a.x * 2 + (CAST(c AS INT) & 1), 'y', a.y * 2 + shiftright(CAST(c AS INT), 1))))"),
    "tile_parent": (f"z {I}, x {L}, y {L}", S, "CASE WHEN z = 0 THEN NULL ELSE to_json(named_struct('z', z - 1, 'x', shiftright(x, 1), 'y', shiftright(y, 1))) END"),
    "tile_count": (f"z {I}", D, "pow(4, z)"),
    "tile_contains": (f"z {I}, x {L}, y {L}, lon {D}, lat {D}", B, f"{_TX} = x AND {_TY} = y"),
}

#: Other names of the same functions, and names that Spark itself has with this meaning.
ALIASES = {
    "nvl": "coalesce", "ifnull": "coalesce", "iif": "if", "len": "char_length", "length": "char_length", "substr": "substring", "chr": "char", "format": "printf",
    "ceiling": "ceil", "trunc": "truncate", "pow": "power", "rand": "random", "getdate": "now", "dateadd": "date_add", "datesub": "date_sub", "in_array": "array_contains",
    "base64_dec": "base64_decode", "unzip": "gunzip", "match": "fts_match", "bm25": "fts_rank", "bitmap_count": "bitmap_count_hex", "haversine_m": "haversine",
    "vec_dot_product": "vec_dot", "vec_inner_product": "vec_dot", "vec_euclidean_distance": "vec_l2_distance", "vec_l1_distance": "vec_manhattan_distance",
    "st_makepoint": "geo_point", "st_point": "geo_point", "geo_x": "geo_lon", "st_x": "geo_lon", "geo_y": "geo_lat", "st_y": "geo_lat", "st_distance": "geo_distance", "st_dwithin": "geo_dwithin",
    "st_within_bbox": "geo_within_bbox", "st_azimuth": "geo_bearing", "st_project": "geo_destination", "st_midpoint": "geo_midpoint", "st_within": "geo_within_polygon", "st_area": "geo_polygon_area",
    "st_length": "geo_length", "st_buffer": "geo_buffer", "st_convexhull": "geo_convex_hull", "st_envelope": "geo_envelope", "st_line_interpolate_point": "geo_line_interpolate",
    "st_intersects": "geo_intersects", "st_disjoint": "geo_disjoint", "st_equals": "geo_equals", "st_simplify": "geo_simplify", "st_bbox": "geo_bbox", "st_centroid": "geo_centroid", "st_affine": "geo_affine",
    "st_smooth": "geo_smooth", "st_remove_holes": "geo_drop_holes", "st_clean": "geo_clean", "st_snaptogrid": "geo_snap", "st_isvalid": "geo_is_valid", "st_clip": "geo_clip", "tile_row_tms": "tile_flip_y",
    "arg_min": "min_by", "arg_max": "max_by", "rlike_match": "regexp_match",
}
