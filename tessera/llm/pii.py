"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

E-mail and IP addresses, telephone, card, account and social-security numbers and dates are found by one
pattern, validated, and replaced by keyed permutations within their own format: a ten-round Feistel network
over the two halves of the digits (or of the letters and digits), whose round function is SHA-256 of key,
kind, length, round and half. It is a bijection for each kind and length, so equal values get equal
pseudonyms in all documents and different ones different pseudonyms. Separators stay where they are; card
numbers keep a right check digit, accounts right check digits, dates stay dates, addresses addresses. Where
only some values of a format are valid, the permutation is repeated until it meets a valid one again (cycle
walking), which is a bijection of the valid values. Addresses are permuted without regard to case.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
#: Steps of a cycle walk. Of the dates' strings 61 % are valid, so a longer walk has a chance under 1e-50; a value whose walk is longer stays.
WALK = 128
#: The setting that holds the key; equal values are linked between runs that share it.
KEY_SETTING = "spark.tessera.pii.key"

#: Bounded and anchored at the begin of a run of its own characters, so that it takes linear time; the at most
#: eight labels are given back one by one, as a full stop may follow the address.
_LOCAL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_DATE = r"(?<![0-9/.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})(?![0-9/-]|\.[0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_CARD = r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
_PHONE = r"(?<![0-9A-Za-z+])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[1-9][0-9]{7,14}+|\+[1-9][0-9]{0,2}(?:[ .-][0-9]{2,5}){2,5})(?![0-9])"
PATTERN = "|".join((_LOCAL, _IP, _DATE, _SSN, _CARD, _IBAN, _PHONE))
#: Texts without any of these have nothing to find.
GATE = r"@|[0-9][0-9 ()./-]{4,}[0-9]|[A-Z]{2}[0-9]{2}[ A-Z0-9]"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with `name` bound to value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _round_value(key: str, kind: str, n: str, i: str, half: str) -> str:
    return f"cast(conv(substr(sha2(concat_ws('|', '{key}', '{kind}', {n}, {i}, {half}), 256), 1, 15), 16, 10) as bigint)"


def _feistel(key: str, kind: str, n: str, left: str, right: str, size_l: str, size_r: str) -> str:
    """SQL: struct l, r of the permuted halves, whole numbers under size_l and size_r."""
    # round values stay under 2^60 and halves under 10^18, so sums don't overflow
    one = f"named_struct('l', pmod(s.l + {_round_value(key, kind, n, 'i', 's.r')}, {size_l}), 'r', s.r)"
    two = f"named_struct('l', s.l, 'r', pmod(s.r + {_round_value(key, kind, n, 'i', 's.l')}, {size_r}))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> if(i % 2 = 0, {one}, {two}))"


def _digits(key: str, kind: str, d: str) -> str:
    """SQL: a permutation of the digit strings of d's length, 2 to 36 digits; others stay."""
    half = "cast(length(dd) div 2 as int)"
    net = _feistel(key, kind, "length(dd)", "substr(dd, 1, hh)", "substr(dd, hh + 1)", "cast(pow(10, hh) as bigint)", "cast(pow(10, length(dd) - hh) as bigint)")
    text = "concat(lpad(cast(f.l as string), hh, '0'), lpad(cast(f.r as string), length(dd) - hh, '0'))"
    body = _let(half, "hh", _let(net, "f", text))
    return _let(d, "dd", f"if(length(dd) between 2 and 36, {body}, dd)")


def _alnum(key: str, kind: str, d: str) -> str:
    """SQL: a permutation of the strings of a-z and 0-9 of d's length, up to 22 characters; longer ones by blocks of 22."""
    half = "cast(length(b) div 2 as int)"
    net = _feistel(key, kind, "concat(length(b), '.', bi)", "if(hh = 0, '0', conv(substr(b, 1, hh), 36, 10))", "conv(substr(b, hh + 1), 36, 10)", "cast(pow(36, hh) as bigint)", "cast(pow(36, length(b) - hh) as bigint)")
    text = "lower(concat(if(hh = 0, '', lpad(conv(cast(f.l as string), 10, 36), hh, '0')), lpad(conv(cast(f.r as string), 10, 36), length(b) - hh, '0')))"
    block = _let("substr(dd, bi * 22 + 1, 22)", "b", f"if(b = '', '', {_let(half, 'hh', _let(net, 'f', text))})")
    return _let(f"lower({d})", "dd", f"concat_ws('', transform(sequence(0, cast((length(dd) - 1) div 22 as int)), bi -> {block}))")


def _walk(value: str, name: str, once: str, valid: str) -> str:
    """SQL: `once`, an expression over `name`, applied to value until `valid`, a condition over `name`, holds again."""
    step = f"if(w.n > 0 and {_let('w.v', name, valid)}, w, named_struct('n', w.n + 1, 'v', {_let('w.v', name, once)}))"
    start = _let(value, "w0", "named_struct('n', 0, 'v', w0)")
    return f"aggregate(sequence(1, {WALK}), {start}, (w, wi) -> {step}, w -> w.v)"


def _put_back(o: str, p: str, others: str) -> str:
    """SQL: the characters of p at the places of o whose characters aren't among `others` (a negated class); the rest of o stays."""
    place = f"length(regexp_replace(substr(oo, 1, i), '{others}', ''))"
    return _let(o, "oo", _let(p, "pp", f"concat_ws('', transform(sequence(1, length(oo)), i -> if(regexp_replace(substr(oo, i, 1), '{others}', '') = '', substr(oo, i, 1), substr(pp, {place}, 1))))"))


def _luhn(d: str, last_doubled: int) -> str:
    """SQL: the digit sum of d modulo 10 with every second digit doubled; last_doubled: 1 if the last one is."""
    digit = "cast(substr(ld, i, 1) as int)"
    twice = f"if({digit} > 4, 2 * {digit} - 9, 2 * {digit})"
    return _let(d, "ld", f"aggregate(sequence(1, length(ld)), 0, (s, i) -> s + if((length(ld) - i + {last_doubled}) % 2 = 1, {twice}, {digit})) % 10")


def _mod97(s: str) -> str:
    """SQL: the account number s with letters as 10 to 35, modulo 97."""
    v = "cast(conv(substr(ms, i, 1), 36, 10) as int)"
    return _let(s, "ms", f"aggregate(sequence(1, length(ms)), 0, (s, i) -> if({v} > 9, s * 100 + {v}, s * 10 + {v}) % 97)")


def _pseudonym(key: str) -> str:
    """SQL over m, one match: struct kind, value; kind is null and value is m where validation fails."""
    digits = "regexp_replace(m, '[^0-9]', '')"
    domain = "substring_index(m, '@', -1)"
    host = f"substr({domain}, 1, length({domain}) - length(substring_index({domain}, '.', -1)))"
    other = "[^A-Za-z0-9]"
    local = _put_back("substring_index(m, '@', 1)", _alnum(key, "local", f"regexp_replace(substring_index(m, '@', 1), '{other}', '')"), other)
    new_host = _put_back(host, _alnum(key, "host", f"regexp_replace({host}, '{other}', '')"), other)
    email = f"named_struct('kind', 'email', 'value', concat({local}, '@', {new_host}, substring_index({domain}, '.', -1)))"

    none = "named_struct('kind', cast(null as string), 'value', m)"
    octets = "transform(split(m, '[.]'), x -> cast(x as int))"
    ip_net = _feistel(key, "ip", "4", "oc[0] * 256 + oc[1]", "oc[2] * 256 + oc[3]", "65536", "65536")
    ip_value = _let(ip_net, "f", "concat_ws('.', f.l div 256, f.l % 256, f.r div 256, f.r % 256)")
    ip = _let(octets, "oc", f"if(exists(oc, x -> x > 255), {none}, named_struct('kind', 'ip', 'value', {ip_value}))")

    # 1900 to 2099 has 73049 days: 319 by 229
    date_net = _feistel(key, "date", "8", "dn div 229", "dn % 229", "319", "229")
    new_day = _let("datediff(day, date'1900-01-01', dt)", "dn", _let(date_net, "f", "date_add(date'1900-01-01', cast(f.l * 229 + f.r as int))"))

    iso = _let("try_to_date(m, 'yyyy-MM-dd')", "dt", f"if(dt is null, {none}, named_struct('kind', 'date', 'value', date_format({new_day}, 'yyyy-MM-dd')))")

    # two numbers up to 31 and a year: a state is (first - 1) * 31 + second - 1 and the year; the valid ones are dates read either way
    def days(month: str) -> str:
        return f"element_at(array(31, if(yy % 4 = 0 and (yy % 100 <> 0 or yy % 400 = 0), 29, 28), 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), {month})"

    ok = "if(d1 between 1 and 31 and d2 between 1 and 31, if(d2 <= 12, d1 <= {0}, false) or if(d1 <= 12, d2 <= {1}, false), false)".format(days("d2"), days("d1"))
    state_ok = _let("cast(sd.l div 31 + 1 as int)", "d1", _let("cast(sd.l % 31 + 1 as int)", "d2", _let("cast(sd.r + 1900 as int)", "yy", ok)))
    walk = _walk("named_struct('l', cast((d1 - 1) * 31 + d2 - 1 as bigint), 'r', cast(yy - 1900 as bigint))", "sd", _feistel(key, "day", "8", "sd.l", "sd.r", "961", "200"), state_ok)
    written = _let(walk, "nd", "concat(lpad(nd.l div 31 + 1, 2, '0'), substr(m, 3, 1), lpad(nd.l % 31 + 1, 2, '0'), substr(m, 6, 1), nd.r + 1900)")
    other_date = _let("cast(substr(m, 1, 2) as int)", "d1", _let("cast(substr(m, 4, 2) as int)", "d2", _let("cast(substr(m, 7, 4) as int)", "yy", f"if({ok}, named_struct('kind', 'date', 'value', {written}), {none})")))
    dates = f"if(m rlike '^[0-9]{{4}}', {iso}, {other_date})"

    # areas 000, 666 and 900 up, group 00 and serial 0000 are never given out
    ssn_ok = "not (substr(ns, 1, 3) in ('000', '666') or substr(ns, 1, 1) = '9' or substr(ns, 4, 2) = '00' or substr(ns, 6, 4) = '0000')"
    ssn_walk = _walk(digits, "ns", _digits(key, "ssn", "ns"), ssn_ok)
    ssn = f"if({_let(digits, 'ns', ssn_ok)}, named_struct('kind', 'ssn', 'value', {_put_back('m', ssn_walk, '[^0-9]')}), {none})"

    body = _digits(key, "card", "substr(d, 2, length(d) - 2)")
    card_new = _let(f"concat(substr(d, 1, 1), {body})", "cb", f"concat(cb, cast((10 - {_luhn('cb', 1)}) % 10 as string))")
    card = _let(digits, "d", f"if({_luhn('d', 0)} = 0 and length(d) between 13 and 19, named_struct('kind', 'card', 'value', {_put_back('m', card_new, '[^0-9]')}), {none})")

    # country stays, digits of the account part are permuted, check digits follow
    acc_digits = "regexp_replace(substr(a, 5), '[^0-9]', '')"
    acc_new = _put_back("substr(a, 5)", _digits(key, "iban", acc_digits), "[^0-9]")
    iban_new = _let(acc_new, "nb", f"concat(substr(a, 1, 2), lpad(cast(98 - {_mod97('concat(nb, substr(a, 1, 2), \'00\')')} as string), 2, '0'), nb)")
    iban = _let("replace(m, ' ', '')", "a", f"if({_mod97('concat(substr(a, 5), substr(a, 1, 4))')} = 1, named_struct('kind', 'iban', 'value', {_put_back('m', iban_new, ' ')}), {none})")

    # the country code stays in front of ten digits
    phone_body = _let(digits, "d", f"if(length(d) > 10, concat(substr(d, 1, length(d) - 10), {_digits(key, 'phone', 'substr(d, -10)')}), {_digits(key, 'phone', 'd')})")
    phone = f"named_struct('kind', 'phone', 'value', {_put_back('m', phone_body, '[^0-9]')})"

    return f"""(case when m like '%@%' then {email}
        when m rlike '^[A-Z]' then {iban}
        when m rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then {ip}
        when m rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}[/.][0-9]{{2}}[/.][0-9]{{4}})$' then {dates}
        when m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {ssn}
        when m rlike '^[0-9]{{13,19}}$|^[0-9]{{4}}[ -][0-9]{{4,6}}[ -]' then {card}
        else {phone} end)"""


def session_key(spark: SparkSession) -> str:
    """The key in the session's setting KEY_SETTING; where that is unset, a random one for this session."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymized(text: str, key: str) -> Column:
    """struct of text, kinds (the kind of each value replaced, in order) from a string column; null stays null."""
    if not key or any(c in key for c in "'\\|"):
        raise ValueError("a key may not be empty nor contain quotes, backslashes or bars")
    found = f"transform(regexp_extract_all(`{text}`, r'{PATTERN}', 0), m -> {_pseudonym(key)})"
    gaps = f"split(`{text}`, r'{PATTERN}', -1)"
    joined = f"concat_ws('', flatten(zip_with({gaps}, found, (g, x) -> array(g, coalesce(x.value, '')))))"
    made = _let(found, "found", f"named_struct('text', {joined}, 'kinds', filter(transform(found, x -> x.kind), x -> x is not null))")
    return F.expr(f"if(`{text}` rlike r'{GATE}', {made}, named_struct('text', `{text}`, 'kinds', cast(array() as array<string>)))")


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """The rows of docs, all columns, with the pseudonymised text in `text`.

    Null and empty texts stay as they are, as do texts without personal data and values that fail their
    validation. Repeated rows are treated alike; an empty table gives no rows.
    """
    return docs.withColumn("text", pseudonymized("text", key)["text"])


def pii_report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_found, kinds (sorted and comma-joined) for every row of docs (doc_id, text); other columns are ignored."""
    out = docs.select("doc_id", pseudonymized("text", key).alias("made"))
    kinds = F.coalesce(F.col("made.kinds"), F.array().cast("array<string>"))
    return out.select("doc_id", F.col("made.text").alias("text"), F.size(kinds).cast("long").alias("n_found"), F.concat_ws(",", F.array_sort(F.array_distinct(kinds))).alias("kinds"))
