"""What becomes of a match of each family of notations, as SQL expressions over the match.

The expressions are text, so that one of several hundred nodes is parsed at once and not put together node by
node. A match fixes its layout, so its parts are taken by position. An expression is NULL where the match is
not a real instant, or where the moved one leaves the calendar.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from tidemark.functions.affine import _DECIMAL_MAX, _LONG_MAX, _SPAN
from tidemark.functions.instants import FIRST_MICRO, LAST_MICRO

_SECOND = 1_000_000
_DAY = 86_400 * _SECOND
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_names = count()


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body`` over a name for ``value``, which is computed once; see :func:`tidemark.functions.bind.let`."""
    name = f"v{next(_names)}"
    return f"array_max(transform(array({value}), {name} -> {body(name)}))"


class Move:
    """The affine map over a struct with the fields ``base, new_base, factor, ceiling``.

    ``factor`` is a number known when the query is built, or None for the field.
    """

    def __init__(self, plan: str, factor: float | None):
        self.plan, self.factor = plan, factor
        if factor is not None:
            self.num, self.den = float(factor).as_integer_ratio()
            if self.num > _DECIMAL_MAX or self.den > _DECIMAL_MAX:
                raise ValueError(f"factor out of range: {factor}")

    def _half_even(self, product: str, whole: str) -> str:
        def rounded(n: str) -> str:
            return let(f"{n} div {whole}", lambda q: let(f"abs({n} % {whole})", lambda r: (
                f"{q} + if({r} > {whole} - {r} or ({r} = {whole} - {r} and pmod({q}, 2) = 1), cast(sign({n}) as bigint), 0L)"
            )))

        return let(product, rounded)

    def _scaled(self, delta: str) -> str:
        if self.factor is None:
            return f"if({self.plan}.factor = 1.0D, {delta}, {self._scaled_by_row(delta)})"
        if self.num == self.den == 1:
            return delta
        if self.den == 1:
            return f"try_multiply({delta}, {self.num}L)" if self.num <= _LONG_MAX else "cast(null as bigint)"
        if self.num * _SPAN <= _LONG_MAX:
            return self._half_even(f"{delta} * {self.num}L", f"{self.den}L")
        product = f"cast(cast({delta} as decimal(19,0)) * cast('{self.num}' as decimal(18,0)) as decimal(38,0))"
        return self._half_even(product, f"cast('{self.den}' as decimal(38,0))")

    def _scaled_by_row(self, delta: str) -> str:
        factor = f"{self.plan}.factor"

        def ratio(p: str) -> str:
            half = f"cast(floor({p} / 2) as int)"
            top = f"cast(cast({factor} * pow(2.0D, {p}) as bigint) as decimal(19,0))"
            low, high = (f"cast(cast(pow(2.0D, {x}) as bigint) as decimal({n},0))" for x, n in ((half, 19), (f"{p} - {half}", 18)))
            product = f"cast(cast({delta} as decimal(19,0)) * {top} as decimal(38,0))"
            return let(f"cast({low} * {high} as decimal(38,0))", lambda whole: self._half_even(product, whole))

        # factor = numerator / 2**power with a numerator that fits a bigint
        return let(f"greatest(0, 53 - cast(floor(log2({factor})) as int))", ratio)

    def __call__(self, us: str) -> str:
        """The moved instant, held at the ceiling."""
        new = let(us, lambda t: f"{self.plan}.new_base + {self._scaled(f'({t} - {self.plan}.base)')}")
        return let(new, lambda m: f"if({m} between {FIRST_MICRO}L and {LAST_MICRO}L, least({m}, {self.plan}.ceiling), null)")


# days and times that do not exist, but for the 29th of February
_NOWHEN = (
    r"(?s)^[0-9]{4}-(?=[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2})"
    r"(?:00|1[3-9]|[2-9]|..-(?:00|3[2-9]|[4-9])|02-3|(?:0[469]|11)-31|.{6}(?:2[4-9]|[3-9])|.{9}[6-9]|.{12}[6-9]).*"
)


def _utc(text: str) -> str:
    """Microseconds of an instant in UTC without its zone; NULL if it is none.

    What cannot be a day or a time is not given to the cast: that raises an error inside, which costs more than
    all the rest of a match.
    """
    return f"unix_micros(try_cast(regexp_replace(concat({text}, 'Z'), {quoted(_NOWHEN)}, '') as timestamp))"


def _wall(text: str) -> str:
    """Microseconds of ``yyyy-MM-dd HH:mm:ss[.f]`` in UTC."""
    read = _utc(text)
    return let(read, lambda t: f"if({t} between {FIRST_MICRO}L and {LAST_MICRO}L, {t}, null)")


def _show(us: str, pattern: str) -> str:
    return f"date_format(timestamp_micros({us}), {quoted(pattern)})"


def _month(name: str) -> str:
    """``Jan`` .. ``Dec`` as two digits; NULL for any other word."""
    return let(f"instr('{_MONTHS}', {name})", lambda at: f"if({at} > 0 and {at} % 3 = 1, lpad(cast(({at} + 2) div 3 as string), 2, '0'), null)")


def _fraction(us: str, digits: str) -> str:
    """``.fff`` with as many digits as before, at most six; nothing where there was none."""
    return f"if({digits} = '', '', concat('.', left({_show(us, 'SSSSSS')}, length({digits}))))"


def _offset(zone: str) -> str:
    """``+HHMM`` or ``+HH:MM`` as microseconds; empty and ``Z`` are UTC; NULL past 23:59."""
    hours, minutes = f"cast(substring({zone}, 2, 2) as bigint)", f"cast(right({zone}, 2) as bigint)"
    size = f"({hours} * 60 + {minutes}) * {60 * _SECOND}L * if({zone} like '-%', -1, 1)"
    return f"case when {zone} in ('', 'Z') then 0L when {hours} <= 23 and {minutes} <= 59 then {size} end"


def _inside(us: str) -> str:
    return f"if({us} between {FIRST_MICRO}L and {LAST_MICRO}L, {us}, null)"


def _iso8601(x: str, move: Move) -> str:
    """With an offset that Spark reads the text is cast as it is; only rare ones are taken apart."""

    def with_parts(zone: str) -> str:
        digits = f"substring({x}, 21, greatest(length({x}) - 20 - length({zone}), 0))"
        midnight = f"(substring({x}, 12, 8) = '24:00:00' and not {digits} rlike '[1-9]')"
        clock = f"concat(left({x}, 10), ' ', if({midnight}, '00:00:00', substring({x}, 12, 8)), '.', rpad(left({digits}, 6), 6, '0'))"

        def moved(offset: str) -> str:
            taken_apart = f"{_wall(clock)} + if({midnight}, {_DAY}L, 0L) - {offset}"
            wall = f"coalesce(if({offset} = 0, {_utc(f'left({x}, length({x}) - length({zone}))')}, null), {taken_apart})"
            return let(f"{move(wall)} + {offset}", lambda new: let(
                f"date_format(timestamp_micros({_inside(new)}), {quoted(chr(39).join(['yyyy-MM-dd', 'T', 'HH:mm:ssSSSSSS']))})",
                # a zero offset is printed with a plus
                lambda d: (
                    f"concat(left({d}, 19), if(length({x}) - length({zone}) < 21, '', "
                    f"concat('.', rpad(substring({d}, 20, length({x}) - 20 - length({zone})), length({x}) - 20 - length({zone}), '0'))), "
                    f"if({offset} = 0, translate({zone}, '-', '+'), {zone}))"
                ),
            ))

        return let(f"if({zone} = '', 0L, {_offset(zone)})", moved)

    # the zone: what follows the last digit of the fraction
    bare = f"(length({x}) = 19 or not (right({x}, 1) = 'Z' or instr(translate(right({x}, 6), '-', '+'), '+') > 0))"
    return let(f"if({bare}, '', regexp_extract(substring({x}, 20), '(Z|[+-][0-9:]+)$', 1))", with_parts)


def _fortigate(x: str, move: Move) -> str:
    return let(move(_wall(f"concat(substring({x}, 6, 10), ' ', right({x}, 8))")), lambda u: _show(u, "'date='yyyy-MM-dd' time='HH:mm:ss"))


def _audit(x: str, move: Move) -> str:
    us = f"(cast(substring({x}, 7, 10) as bigint) * {_SECOND}L + cast(substring({x}, 18, 3) as bigint) * 1000L)"
    return let(move(us), lambda u: f"concat('audit(', cast({u} div {_SECOND}L as string), '.', {_show(u, 'SSS')}, substring({x}, 21))")


def _syslog(x: str, move: Move) -> str:
    day = f"lpad(regexp_extract({x}, '([0-9]+).{{9}}$', 1), 2, '0')"
    clock = f"concat({_show(f'{move.plan}.base', 'yyyy-')}, {_month(f'left({x}, 3)')}, '-', {day}, ' ', right({x}, 8))"
    return let(move(_wall(clock)), lambda u: f"concat({_show(u, 'MMM ')}, lpad({_show(u, 'd')}, 2, ' '), {_show(u, ' HH:mm:ss')})")


def _us_date(x: str, move: Move) -> str:
    def with_parts(p: str) -> str:
        date, time, half = f"{p}[0]", f"{p}[1]", f"get({p}, 2)"
        hour = (
            f"case when {half} = 'AM' and left({time}, 2) = '12' then '00' "
            f"when {half} = 'PM' and left({time}, 2) < '12' then cast(cast(left({time}, 2) as int) + 12 as string) else left({time}, 2) end"
        )
        digits = f"substring({time}, 10)"
        clock = (
            f"concat(substring({date}, 7, 4), '-', left({date}, 2), '-', substring({date}, 4, 2), ' ', {hour}, "
            f"substring({time}, 3, 6), '.', rpad(left({digits}, 6), 6, '0'))"
        )
        return let(move(_wall(clock)), lambda u: (
            f"concat(if({half} is null, {_show(u, 'MM/dd/yyyy HH:mm:ss')}, {_show(u, 'MM/dd/yyyy hh:mm:ss')}), {_fraction(u, digits)}, "
            f"if({half} is null, '', {_show(u, ' a')}))"
        ))

    return let(rf"split({x}, '\\s+')", with_parts)


def _clf(x: str, move: Move) -> str:
    def with_offset(offset: str) -> str:
        clock = f"concat(substring({x}, 9, 4), '-', {_month(f'substring({x}, 5, 3)')}, '-', substring({x}, 2, 2), ' ', substring({x}, 14, 8))"
        new = let(f"{move(f'{_wall(clock)} - {offset}')} + {offset}", _inside)
        return let(new, lambda u: f"concat({_show(u, chr(39) + '[' + chr(39) + 'dd/MMM/yyyy:HH:mm:ss ')}, right({x}, 6))")

    return let(_offset(f"substring({x}, length({x}) - 5, 5)"), with_offset)


def _apache_error(x: str, move: Move) -> str:
    def with_parts(p: str) -> str:
        digits = f"substring({p}[3], 10)"
        clock = (
            f"concat(left({p}[4], 4), '-', {_month(f'{p}[1]')}, '-', lpad({p}[2], 2, '0'), ' ', left({p}[3], 8), '.', "
            f"rpad(left({digits}, 6), 6, '0'))"
        )
        return let(move(_wall(clock)), lambda u: f"concat('[', {_show(u, 'EEE MMM dd HH:mm:ss')}, {_fraction(u, digits)}, {_show(u, ' yyyy')}, ']')")

    return let(rf"split({x}, '\\s+')", with_parts)


def _ctime(x: str, move: Move) -> str:
    def with_parts(p: str) -> str:
        mail = f"({p}[1] <= '99')"
        year, month, day, time = (f"if({mail}, {p}[{a}], {p}[{b}])" for a, b in ((3, 4), (2, 1), (1, 2), (4, 3)))
        clock = f"concat({year}, '-', {_month(month)}, '-', lpad({day}, 2, '0'), ' ', {time})"
        comma = f"if(instr(left({x}, 5), ', ') > 0, ', ', ' ')"
        return let(move(_wall(clock)), lambda u: (
            f"concat(if({mail}, concat({_show(u, 'EEE')}, {comma}, {_show(u, 'd MMM yyyy HH:mm:ss')}), "
            f"concat({_show(u, 'EEE MMM ')}, lpad({_show(u, 'd')}, 2, ' '), {_show(u, ' HH:mm:ss yyyy')})), "
            f"coalesce(concat(' ', get({p}, 5)), ''))"
        ))

    return let(rf"split({x}, '\\s+')", with_parts)


def _dated(date: Callable[[str], str], pattern: str) -> Callable[[str, Move], str]:
    def put(x: str, move: Move) -> str:
        return let(move(_wall(f"concat({date(x)}, ' ', right({x}, 8))")), lambda u: _show(u, pattern))

    return put


def _millis(us: str) -> str:
    """Whole milliseconds as printed from a double of seconds."""
    return f"cast(cast(cast({us} as double) / 1e6D * 1000.0D as bigint) as string)"


def _epoch_ms(x: str, move: Move) -> str:
    return let(move(f"cast(right({x}, 13) as bigint) * 1000L"), lambda u: f"concat(left({x}, length({x}) - 13), {_millis(u)})")


def _dotnet(x: str, move: Move) -> str:
    return let(move(f"cast(substring({x}, 7, 13) as bigint) * 1000L"), lambda u: f"concat('/Date(', {_millis(u)}, ')/')")


def _epoch(x: str, move: Move) -> str:
    new = move(f"cast(right({x}, 10) as bigint) * {_SECOND}L")
    return let(new, lambda u: f"concat(left({x}, length({x}) - 10), cast({u} div {_SECOND}L as string))")


# family -> the text that a match becomes
PUT: dict[str, Callable[[str, Move], str]] = {
    "iso8601": _iso8601, "fortigate": _fortigate, "audit": _audit, "syslog": _syslog, "us_date": _us_date,
    "clf": _clf, "apache_error": _apache_error, "ctime": _ctime,
    "panos": _dated(lambda x: f"translate(left({x}, 10), '/', '-')", "yyyy/MM/dd HH:mm:ss"),
    "datetime": _dated(lambda x: f"left({x}, 10)", "yyyy-MM-dd HH:mm:ss"),
    "compact": _dated(lambda x: f"concat(left({x}, 4), '-', substring({x}, 5, 2), '-', substring({x}, 7, 2))", "yyyyMMdd HH:mm:ss"),
    "epoch_ms": _epoch_ms, "dotnet": _dotnet, "epoch": _epoch,
}
