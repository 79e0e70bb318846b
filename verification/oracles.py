"""The registered queries as SQL for DuckDB, over the domain tables of binding.sql."""

from __future__ import annotations

import re
from pathlib import Path

_SCRIPT = (Path(__file__).parent / "binding.sql").read_text(encoding="utf-8")
BINDING = dict(re.findall(r"CREATE OR REPLACE TEMP VIEW (\w+) AS\n(.*?);", _SCRIPT, re.S))

AS_OF = "DATE '2001-12-31'"
_MONTHS = (
    "['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre',"
    "'octubre','noviembre','diciembre']"
)
_GROUP_LINE = "chr(10) || '---------------------' || chr(10)"
_GROUP_GAP = "' ' || chr(10) || ' ' || chr(10) || '  '"


def _words(sql: str) -> set[str]:
    return set(re.findall(r"\w+", sql))


def with_binding(sql: str) -> str:
    """`sql` preceded by the domain tables it reads, directly or through another table."""
    needed: list[str] = []
    wanted = _words(sql)
    for name in reversed(BINDING):
        if name in wanted:
            needed.insert(0, name)
            wanted |= _words(BINDING[name])
    views = [f"{name} AS ({BINDING[name]})" for name in needed]
    return "WITH " + ",\n".join(views) + "\n" + sql.strip()


def _spanish(date: str) -> str:
    return (
        f"lpad(cast(day({date}) as varchar), 2, '0') || '-' || {_MONTHS}[month({date})] || '-' || "
        f"cast(year({date}) as varchar)"
    )


def _strict(c: str) -> str:
    return (
        f"case {c} when 0 then 'adelantada' when 1 then 'adelantada' when 2 then 'en el rango' "
        f"when 3 then 'tardía' when 4 then 'tardía' else 'validar' end"
    )


def _quarter(start: str, end: str, quarter: int) -> str:
    first, last = [
        ("01-01", "03-31"), ("04-01", "06-30"), ("07-01", "09-30"), ("10-01", "12-31")
    ][quarter - 1]
    low, high = 3 * quarter - 2, 3 * quarter

    def at(text: str) -> str:
        return f"cast(cast(y as varchar) || '-{text}' as date)"

    begins, ends = f"greatest({start}, {at('01-01')})", f"least({end}, {at('12-31')})"
    days = (
        f"case when month({begins}) > {high} or month({ends}) < {low} then 0 "
        f"else datediff('day', greatest({begins}, {at(first)}), least({ends}, {at(last)})) end"
    )
    years = f"range(year({start}), year({end}) + 1)"
    return (
        f"case when {start} is null or {end} is null or {start} = {end} then null else "
        f"cast(coalesce(list_sum(list_transform({years}, lambda y: {days})), 0) as double) "
        f"/ datediff('day', {start}, {end}) end"
    )


_DATES = """(
  select distinct descripcion, fecha from (
    select descripcion, case when propia then fecha else max(fecha) over (partition by descripcion, tabla) end as fecha
    from (
      select descripcion, fecha, true as propia, 0 as tabla from grupossiembra
      union all select descripcion, fecha, false, 1 from gruposforza
      union all select descripcion, fecha, false, 2 from gruposforza2
      union all select descripcion, fecha, false, 3 from grupossemillero
      union all select descripcion, fecha, false, 4 from grupos2dacosecha) tagged) latest)"""


def _group_quality(keys: str = "etapa2, categoria,", where: str = "") -> str:
    return f"""
select {keys}
  '[' || coalesce(g, '') || '](/' || etapa2 || '-detalle-grupo?grupo=' || coalesce(g, '')
    || '#' || categoria || ')' as grupo,
  g as "nombre grupo", fecha as "fecha inicio grupo", numero_bloques, bloques_por_forzar,
  max_aplicaciones_tardias, max_aplicaciones_adelantadas, max_aplicaciones_pendientes
from (
  select etapa2, categoria, grupo as g, count(bloque) as numero_bloques,
    count(bloque) filter (where finduccion is null) as bloques_por_forzar,
    cast(max(aplicaciones_con_retraso) as bigint) as max_aplicaciones_tardias,
    cast(max(aplicaciones_muy_proximas) as bigint) as max_aplicaciones_adelantadas,
    cast(max(aplicaciones_pendientes) as bigint) as max_aplicaciones_pendientes
  from calidad_aplicaciones {where} group by etapa2, categoria, grupo) q
left join {_DATES} f on q.g = f.descripcion"""


_LONG = f"""
select year("fecha inicio grupo") as anio, etapa2, categoria, "nombre grupo", calidad, n
from ({_group_quality()}) q,
  lateral (values ('tardía', max_aplicaciones_tardias),
    ('adelantada', max_aplicaciones_adelantadas),
    ('pendiente', max_aplicaciones_pendientes)) v(calidad, n)
where "fecha inicio grupo" is not null"""


def _month_rows(table: str, calidad: str) -> str:
    return f"""
select etapa2, categoria, grupo, area / 10000 as area_aplicacion, lote,
  cast(date_trunc('month', fecha) as date) as mes, 1 as conteo, {calidad} as calidad
from {table} a left join blocks b on a.blocknumber = b.codigo"""


_MONTHLY = (
    _month_rows("aplicaciones", _strict("calidad"))
    + " union all "
    + _month_rows("aplicaciones_pendientes", "'pendiente'")
)
_BY_GROUP = f"""
select etapa2, categoria, mes, grupo, calidad, count(*) as conteo from ({_MONTHLY}) m
where mes is not null and grupo is not null group by 1, 2, 3, 4, 5"""
_TOTALS = f"""
select etapa2, categoria, mes, calidad, cast(sum(conteo) as bigint) as conteo
from ({_BY_GROUP}) g group by 1, 2, 3, 4"""

_LAST_WEIGHT = """
select llave, cast(sum(valor) as double) / count(valor) / 1000 as peso_forza
from (
  select p.llave, p.valor, rank() over (partition by p.llave order by p.fecha desc) as r
  from pesoplanta p join blocks_desarrollo d on d.bloque = p.llave
  where coalesce(p.fecha < d.finduccion, true)) s
where r = 1 group by llave"""

_MODEL_BASE = f"""
select d.blocknumber, b.descripcion, d.desarrollo, d.desarrollo || d.blocknumber as llave,
  d.fecha_siembra, p.fecha_siembra as fecha_siembra_pc, b.dias_hasta_siembra_grupo,
  d.grupo_forza, d.finduccion, d.finduccion + 140 as mean_fecha_cosecha, b.area, b.drenajes,
  b.poblacion / b.area as densidad, p.kilos_cosechados / b.area as productividad_pc,
  p.frutas / b.poblacion as recuperacion_pc, b.rango_semilla, w.peso_forza,
  c.kilos_cosechados, c.frutas
from blocks_desarrollo d
left join blocks_detalle b on b.blocknumber = d.blocknumber
left join blocks_desarrollo p
  on p.blocknumber = d.blocknumber and p.desarrollo = 'PC' and d.desarrollo = 'SC'
left join ({_LAST_WEIGHT}) w on w.llave = d.desarrollo || d.blocknumber
left join cosecha_resumen c on c.desarrollo || c.blocknumber = d.desarrollo || d.blocknumber"""

# Mean and width in grams of the seed ranges.
_RANGES = """(values
  ('CM COLINO MEDIO ENTRE 300-500 G', 400, 200),
  ('CG COLINO GRANDE ENTRE 501-700 G', 600, 200),
  ('RANGO 1 ( DE 300 A 700)', 500, 400),
  ('RANGO 2 (DE 701 A 1000', 850, 300),
  ('RANGO 3 (DE 1001 A 1500)', 1250, 500),
  ('R-1 (DE 250 A 550)', 400, 300),
  ('R-2 (DE 551 A 900)', 725, 350),
  ('RANG. 1 (DE 400 A 600)', 500, 200),
  ('RANG. 2 (DE 601 A 900)', 750, 300),
  ('RG. 1 (250 A 600)', 425, 350),
  ('R-3 ( DE 901 A 1500)', 1200, 600),
  ('RANGO 2 (RAIZ)', 700, 200),
  ('R.2 (601-900)', 750, 300),
  ('R.3 (901-1200)', 1050, 300),
  ('R.1 (450-600)', 525, 150),
  ('R.0 (250-450)', 350, 200),
  ('R3: (601-900)', 750, 300),
  ('R2: (451-600)', 525, 150),
  ('R:4 (901-1200)', 1050, 300),
  ('R1: (250-450)', 350, 200)) r(rango, media, ancho)"""

_FEATURES = f"""
select area, ancho, descripcion, desarrollo, dias_hasta_siembra_grupo, drenajes, densidad,
  grupo_forza, kilos_cosechados, frutas, llave, media, peso_forza, productividad_pc,
  recuperacion_pc, media as media_rango_semilla, ancho as ancho_rango_semilla,
  datediff('day', fecha_siembra, finduccion) / 30 as edad_forza,
  datediff('day', finduccion, mean_fecha_cosecha) / 30 as edad_cosecha,
  datediff('day', fecha_siembra_pc, fecha_siembra) / 30 as edad_inicio_sc,
  {_quarter("finduccion", "mean_fecha_cosecha", 1)} as proporcion_posforza_t1,
  {_quarter("finduccion", "mean_fecha_cosecha", 4)} as proporcion_posforza_t4
from ({_MODEL_BASE}) m left join {_RANGES} on m.rango_semilla = r.rango"""

_NUMERIC = """area, drenajes, peso_forza, densidad, media_rango_semilla, ancho_rango_semilla,
  edad_forza, edad_cosecha, proporcion_posforza_t1, proporcion_posforza_t4,
  dias_hasta_siembra_grupo, productividad_pc, recuperacion_pc, edad_inicio_sc"""

_READY = f"""
select d.bloque, d.blocknumber, d.desarrollo, d.grupo_siembra, d.fecha_siembra,
  datediff('day', d.fecha_siembra, {AS_OF}) / 30 as edad, s.fecha as fecha_muestreo, s.peso
from blocks_desarrollo d
left join (
  select llave, fecha, cast(sum(valor) as double) / count(valor) as peso,
    row_number() over (partition by llave order by fecha desc) as n
  from pesoplanta group by llave, fecha) s on s.llave = d.bloque and s.n = 1
where d.finduccion is null and right(d.bloque, 1) <> 'J'
  and d.fecha_siembra >= DATE '1998-01-01'
  and (edad > 10 and d.desarrollo = 'PC' or s.peso > 2500 and d.desarrollo = 'PC'
    or edad > 3 and d.desarrollo = 'SC')"""


def _alert(stages: str, condition: str) -> str:
    return f"""
select bloque, grupo, fecha, descripcion_formula,
  cast(datediff('day', fecha, {AS_OF}) as int) as dias_desde_ultima_aplicacion
from (
  select *, row_number() over (partition by bloque
    order by fecha desc nulls first, codigo_formula, grupo, descripcion_formula) as n
  from aplicaciones
  where etapa in ({stages}) and categoria = 'nutricion' and grupo is not null and {condition}) a
where n = 1"""


_PREFORZA = _alert(
    "'Post Siembra', 'Post Deshija'",
    "bloque in (select bloque from blocks_desarrollo where finduccion is null)",
)
_POSTFORZA = _alert("'Post Forza'", "bloque not in (select bloque from cosecha_resumen)")
_SEMILLERO = _alert(
    "'Post Poda'", "blocknumber in (select blocknumber from siembra where estado in ('3', '7'))"
)
_NEW = f"""
select bloque, fecha_siembra, cast(datediff('day', fecha_siembra, {AS_OF}) as int) as dias_sin_aplicacion
from blocks_desarrollo
where finduccion is null and bloque not in (select bloque from aplicaciones)"""


def _alert_list(rows: str, lot: str) -> str:
    return f"""
select * replace ({_spanish("fecha")} as fecha) from (
  select fecha, descripcion_formula, {lot} dias_desde_ultima_aplicacion, grupo, bloque,
    count(bloque) as veces
  from (select *, substr(bloque, 3, 2) as lote from ({rows}) r
    where dias_desde_ultima_aplicacion <= 100) s
  group by all) g"""


_CURRENT = """
select bloque, case when finduccion2 is not null then grupo_forza2
  when deshija is not null then grupo_2da_cosecha when poda is not null then grupo_semillero
  when finduccion is not null then grupo_forza when siembra is not null then grupo_siembra
  else 'VALIDAR GRUPO' end as grupo
from historia_bloques where grupo_siembra is not null"""


def _program_rows(where: str = "", group: str = "grupo") -> str:
    return f"""
select fecha, codformula, formula, {group} as grupo, block as bloque, count(block) as veces
from (select distinct formula, block, fecha, area, codformula from programacionaplicaciones
  {where}) p
left join ({_CURRENT}) g on g.bloque = p.block
group by all"""


_PROGRAM_AREA = f"""
select fecha, codformula, formula, grupo,
  cast(round(sum(cast(area as decimal(18, 4))), 2) as double) as area, count(*) as entradas
from (select distinct formula, block, fecha, area, codformula from programacionaplicaciones) p
left join ({_CURRENT}) g on g.bloque = p.block
group by all"""


def _program(where: str = "") -> str:
    return f"""
select * replace ({_spanish("fecha")} as fecha)
from ({_program_rows(where, "coalesce(grupo, 'VALIDAR GRUPO')")}) r"""


_DONE = """
select bloque, etapa2, categoria, blocknumber, codigo_cedula as "codigo cédula", fecha,
  '[' || codigo_formula || '](/detalle-formula?codigo=' || replace(codigo_formula, ' ', '_')
    || ')' as "código fórmula",
  descripcion_formula as formula, motivo,
  dias_diferencia as "dias desde la aplicación anterior",
  case when calidad in (0, 1) then 'adelantada' when calidad in (3, 4) then 'tardía'
    else 'en el rango' end as color,
  case when calidad in (0, 1) then 1 when calidad in (3, 4) then 3 else 2 end as calificacion
from aplicaciones"""
_DONE_ALL = """
select distinct bloque, etapa2, blocknumber, codigo_cedula as "codigo cédula", fecha,
  descripcion_formula as formula, motivo, 'sin calificar' as color, 0 as calificacion
from aplicaciones"""
_PENDING = """
select bloque, fecha, categoria, etapa, etapa2, -1 as calificacion, 'pendiente' as color,
  'pendiente' as formula
from aplicaciones_pendientes"""


def _status(cast: str = "") -> str:
    def group(column: str, page: str, parameter: str) -> str:
        return (
            f"'[' || coalesce({column}, '') || '](/{page}-detalle-grupo?{parameter}=' || "
            f"coalesce({column}, '') || ')'"
        )

    def stage(column: str, page: str, cycle: str) -> str:
        return (
            f"'[' || coalesce(cast({column} as varchar), '') || "
            f"'](/{page}-detalle-bloque?bloque={cycle}' || bloque || ')'"
        )

    def plain(column: str) -> str:
        return f"coalesce(cast({column} as varchar), '')" if cast else column

    return f"""
select lote, bloque, {group("grupo_siembra", "preforza", "gs")} as "grupo de siembra",
  {group("grupo_forza", "postforza", "gf")} as "grupo de forza",
  {group("grupo_semillero", "semillero", "gse")} as "grupo semillero",
  {group("grupo_2da_cosecha", "preforza", "gs")} as "grupo inicio 2da",
  {group("grupo_forza2", "postforza", "gf")} as "grupo forza 2da",
  {stage("siembra", "preforza", "PC")} as siembra,
  {stage("finduccion", "postforza", "PC")} as "induccion pc",
  {plain("fecha_cosecha_pc")} as "cosecha 1ra", {plain("poda")} as poda,
  {stage("deshija", "preforza", "SC")} as deshija,
  {stage("finduccion2", "postforza", "SC")} as "induccion 2da",
  {plain("fecha_cosecha_sc")} as "cosecha 2da", {plain("semillerosegunda")} as "semillero 2da",
  {plain("barrido")} as barrido
from historia_bloques"""


_BLOCK_QUALITY = """
select grupo, categoria,
  '[' || bloque || '](/' || etapa2 || '-detalle-bloque?bloque=' || bloque || '#' || categoria
    || ')' as bloque,
  fecha_siembra as "fecha de siembra", finduccion as "fecha de inducción",
  cast(aplicaciones_pendientes as bigint) as "# de aplicaciones pendientes",
  cast(num_aplicaciones_realizadas as bigint) as "# de aplicaciones realizadas",
  cast(aplicaciones_con_retraso as bigint) as "# de aplicaciones realizadas tardías",
  cast(aplicaciones_muy_proximas as bigint) as "# de aplicaciones realizadas adelantadas"
from calidad_aplicaciones"""

_ORDERS = """
select grupo, etapa2, categoria, codigo_cedula as "codigo cédula", fecha as "fecha aplicación",
  descripcion_formula as formula, blocknumber as bloque, count(blocknumber) as veces
from aplicaciones group by all"""

_CANDIDATES = f"""
select r.bloque, r.desarrollo, r.grupo_siembra as "grupo siembra",
  r.fecha_siembra as "fecha siembra", b.poblacion,
  b.area * (1 - b.drenajes) / 10000 as "area neta (ha)",
  b.poblacion / (b.area * (1 - b.drenajes) / 10000) as densidad, edad as "edad actual meses",
  r.fecha_muestreo as "fecha ultimo muestreo", r.peso as "peso promedio ultimo muestreo",
  b.rango_semilla as "rango semilla"
from ({_READY}) r left join blocks_detalle b using (blocknumber)"""


def _blank(column: str) -> str:
    return f'coalesce(cast("{column}" as varchar), \'\') as "{column}"'


_RATIOS = """blocknumber, area * (1 - drenajes) / 10000 as area_neta,
  poblacion / (area * (1 - drenajes) / 10000) as densidad, poblacion / area as por_area,
  case when drenajes = 0 then null else area / drenajes end as por_drenaje"""


def _rounded(column: str) -> str:
    """Two digits, half up, by way of decimals."""
    return f"cast(round(cast({column} as decimal(18, 8)), 2) as double) as {column}"


_TRAINING = f"""
select descripcion, grupo_forza, llave, desarrollo, kilos_cosechados, frutas,
  {", ".join(f"cast({c.strip()} as double) as {c.strip()}" for c in _NUMERIC.split(","))},
  kilos_cosechados / area as rendimiento
from ({_FEATURES}) f where kilos_cosechados is not null and area <> 0"""


def _models(folds: int) -> str:
    """CTEs up to `model`: for each crop and fold (all rows with one fold) the labels' mean, and weight
    and mean of each input. Correlations with a penalty, solved by elimination without pivoting."""
    names = [c.strip() for c in _NUMERIC.split(",")]
    p, label = len(names), len(names) + 1
    first = [k for k, c in enumerate(names, 1) if c not in ("productividad_pc", "recuperacion_pc", "edad_inicio_sc")]
    second = [k for k, c in enumerate(names, 1) if c != "dias_hasta_siembra_grupo"]
    return f"""trained as materialized (
  select *, row_number() over () as id, ('0x' || substr(md5(llave), 1, 7))::int % {folds} as parte,
    [1.0, {", ".join(names)}, rendimiento]::double[] as x
  from ({_TRAINING}) t
), entry as materialized (select id, desarrollo, parte, k, x[k + 1] as x from trained, range({p + 2}) r(k) where x[k + 1] is not null
), moment as materialized (
  select a.desarrollo, a.parte, a.k as i, b.k as j, count(*) as n, sum(a.x) as si, sum(b.x) as sj, sum(a.x * b.x) as sij
  from entry a join entry b on a.id = b.id and a.k <= b.k group by all
), seen as (
  select o.desarrollo, o.parte, i, j, sum(n) as n, sum(si) as si, sum(sj) as sj, sum(sij) as sij
  from moment m join (select distinct desarrollo, parte from trained) o
    on m.desarrollo = o.desarrollo and ({folds} = 1 or m.parte <> o.parte)
  group by all
), mean as (select desarrollo, parte, j as k, sj / n as m from seen where i = 0
), spread as (
  select s.desarrollo, s.parte, i, j, sij, sij - a.m * sj - b.m * si + n * a.m * b.m as c
  from seen s join mean a on (a.desarrollo, a.parte, a.k) = (s.desarrollo, s.parte, s.i)
  join mean b on (b.desarrollo, b.parte, b.k) = (s.desarrollo, s.parte, s.j)
), used as (
  select desarrollo, parte, i as k, sqrt(c) as unit from spread
  where i = j and c > 1e-9 * sij
    and list_contains(case desarrollo when 'PC' then {first} else {second} end, i)
), cell as (
  select s.desarrollo, s.parte, i, j, c / a.unit / case when j = {label} then 1 else b.unit end as v
  from spread s join used a on (a.desarrollo, a.parte, a.k) = (s.desarrollo, s.parte, s.i)
  left join used b on (b.desarrollo, b.parte, b.k) = (s.desarrollo, s.parte, s.j)
  where j = {label} or b.unit is not null
), full_cell as (
  select desarrollo, parte, i, j, case when i = j then 1 + 0.01 else v end as v from cell
  union all select desarrollo, parte, j, i, v from cell where i < j and j < {label}
), equation as (
  select desarrollo, parte, list(line order by i) as a from (
    select o.desarrollo, o.parte, i, list(coalesce(v, case when i = j then 1 else 0 end) order by j) as line
    from (select distinct desarrollo, parte from mean) o cross join range(1, {p + 1}) r(i) cross join range(1, {p + 2}) q(j)
    left join full_cell f using (desarrollo, parte, i, j) group by all) l
  group by all
), solving as (
  select desarrollo, parte, 1 as k, a from equation
  union all select desarrollo, parte, k + 1, list_transform(a, lambda line, i: case when i = k
      then list_transform(line, lambda v: v / line[k])
      else list_transform(line, lambda v, j: v - line[k] * a[k][j] / a[k][k]) end)
  from solving where k <= {p}
), term as (
  select desarrollo, parte, r.k, a[r.k][{label}] / unit as w, m
  from (select desarrollo, parte, a from solving where k = {label}) s cross join range(1, {label}) r(k)
  join used using (desarrollo, parte, k) join mean using (desarrollo, parte, k)
), model as (
  select b.desarrollo, b.parte, b.m as base, list([t.k, w, t.m]) filter (t.k is not null) as terms
  from mean b left join term t on (t.desarrollo, t.parte) = (b.desarrollo, b.parte) where b.k = {label} group by all
)"""


def _predicted(x: str) -> str:
    """The model's prediction for a list of inputs."""
    return (
        f"base + coalesce(list_sum(list_transform(terms, lambda t: coalesce(t[2] * (({x})[t[1]::int] - t[3]), 0))), 0)"
    )


_FOLDS = f"""with recursive {_models(5)}
select llave, desarrollo, cast(parte as int) as parte, rendimiento, {_predicted("x[2:]")} as prediccion
from trained left join model using (desarrollo, parte)"""

_SQL = {
    "harvest_forecast_linear": f"""select * from (with recursive {_models(1)}
select llave, desarrollo, "Semanas adicionales", "peso forza proyectado", area, round(prediccion, 6) as prediccion,
  round(prediccion * area, 3) as "kilos proyectados"
from (
  select f.*, {_predicted("[" + _NUMERIC + "]::double[]")} as prediccion
  from (__FEATURED__) f left join model using (desarrollo)) p) q""".replace(
        "__FEATURED__",
        _FEATURES.replace("select area,", 'select "Semanas adicionales", "peso forza proyectado", area,').replace(
            _MODEL_BASE,
            f"""
select m.* exclude (finduccion, mean_fecha_cosecha, peso_forza), paso as "Semanas adicionales",
  r.peso + 200 * paso as "peso forza proyectado", (r.peso + 200 * paso) / 1000 as peso_forza,
  {AS_OF} + dias as finduccion, {AS_OF} + dias + 140 as mean_fecha_cosecha
from ({_READY}) r join ({_MODEL_BASE}) m on m.llave = r.bloque
cross join (values (0, 0), (1, 7), (2, 15), (3, 21), (4, 29)) v(paso, dias)""",
        ),
    ),
    "harvest_folds": f"""
select * replace (round(rendimiento, 6) as rendimiento, round(prediccion, 6) as prediccion) from ({_FOLDS}) f""",
    "harvest_fold_errors": f"""
select desarrollo, count(*) as filas, round(avg(abs(prediccion - rendimiento)), 6) as error_medio,
  round(sqrt(avg((prediccion - rendimiento) ** 2)), 6) as error_cuadratico,
  round(1 - avg((prediccion - rendimiento) ** 2) / var_pop(rendimiento), 6) as explicado
from ({_FOLDS}) f where prediccion is not null group by desarrollo""",
    "in_list_filter": """
select bloque, grupo, fecha, etapa, categoria, codigo_cedula from aplicaciones
where etapa in ('Post Siembra', 'Post Deshija')""",
    "quality_bucket_strict": f"""
select bloque, codigo_cedula, fecha, calidad, {_strict("calidad")} as clase from aplicaciones""",
    "quality_bucket_lenient": """
select bloque, codigo_cedula, fecha, calidad,
  case when calidad in (0, 1) then 'adelantada' when calidad in (3, 4) then 'tardía'
    else 'en el rango' end as color,
  case when calidad in (0, 1) then 1 when calidad in (3, 4) then 3 else 2 end as calificacion
from aplicaciones""",
    "text_functions": """
select bloque, codigo_cedula, concat(etapa2, grupo) as clave,
  concat('[', grupo, '](/preforza-detalle-grupo?grupo=', grupo, ')') as enlace,
  replace(codigo_formula, ' ', '_') as guiones, codigo_formula as espacios,
  codigo_formula as recortado, substr(bloque, 3, 2) as lote, grupo || ':' || bloque as grupo_bloque,
  strip_accents('Protección ñandú Ü ' || categoria) as sin_acentos,
  'ver ' || codigo_formula || '.' as texto
from aplicaciones""",
    "date_functions": f"""
select bloque, codigo_cedula, fecha, cast(date_trunc('month', fecha) as date) as mes,
  cast(year(fecha) as int) as anio, cast(weekofyear(fecha) as int) as semana,
  cast(isoyear(fecha) as int) as anio_iso, year(fecha) = 1999 as en_1999,
  year(fecha) = 1999 and weekofyear(fecha) = 53 as en_semana_53,
  cast(isoyear({AS_OF}) as int) as anio_actual, cast(weekofyear({AS_OF}) as int) as semana_actual,
  cast(datediff('day', fecha, {AS_OF}) as int) as dias,
  datediff('day', fecha, {AS_OF}) / 30 as meses, fecha + 140 as cosecha,
  {_spanish("fecha")} as texto
from aplicaciones""",
    "ratio_functions": f"select {_RATIOS} from blocks_detalle",
    "rounded_ratios": f"""
select blocknumber, {_rounded("area_neta")}, {_rounded("densidad")}, {_rounded("por_area")},
  {_rounded("por_drenaje")}
from (select {_RATIOS} from blocks_detalle) r""",
    "quarter_share": "select bloque, "
    + ", ".join(
        f"{_quarter('finduccion', '(finduccion + 140)', q)} as posforza_t{q}, "
        f"{_quarter('fecha_siembra', 'mediana_fecha_cosecha', q)} as ciclo_t{q}"
        for q in (1, 2, 3, 4)
    )
    + " from blocks_desarrollo",
    "seed_range_features": f"""
select blocknumber, rango_semilla, media as media_rango_semilla, ancho as ancho_rango_semilla
from blocks_detalle left join {_RANGES} on rango_semilla = rango""",
    "age_features": f"""
select llave, datediff('day', fecha_siembra, finduccion) / 30 as edad_forza,
  datediff('day', finduccion, mean_fecha_cosecha) / 30 as edad_cosecha,
  datediff('day', fecha_siembra_pc, fecha_siembra) / 30 as edad_inicio_sc
from ({_MODEL_BASE}) m""",
    "group_dates": f"select * from {_DATES} f",
    "group_quality": _group_quality(),
    "group_quality_page": _group_quality(
        "", "where etapa2 = 'preforza' and categoria = 'nutricion'"
    ),
    "groups_started_in_year": f"""
select *, cast(year("fecha inicio grupo") as int) as anio from ({_group_quality()}) q
where "fecha inicio grupo" is not null""",
    "group_quality_long": f"""
select cast(anio as int) as anio, etapa2, categoria, "nombre grupo", calidad,
  n as "Número máximo de aplicaciones"
from ({_LONG}) g""",
    "group_quality_totals": f"""
select cast(anio as int) as anio, etapa2, categoria, "nombre grupo", calidad,
  cast(sum(n) as bigint) as total
from ({_LONG}) g group by all""",
    "tolerance_lookup": """
select dias_entre_aplicaciones, tolerancia_rango_inferior, tolerancia_rango_superior
from rangos_calidad_aplicaciones where etapa2 = 'preforza' and categoria = 'nutricion'
order by all limit 1""",
    "tolerances_in_use": """
select etapa2, categoria, dias_entre_aplicaciones, tolerancia_rango_inferior, tolerancia_rango_superior
from (select distinct etapa2, categoria from calidad_aplicaciones) u
left join (
  select * from rangos_calidad_aplicaciones qualify row_number() over (partition by etapa2, categoria
    order by dias_entre_aplicaciones, tolerancia_rango_inferior, tolerancia_rango_superior) = 1
) r using (etapa2, categoria)""",
    "monthly_quality_rows": _month_rows("aplicaciones", _strict("calidad")),
    "monthly_pending_rows": _month_rows("aplicaciones_pendientes", "'pendiente'"),
    "monthly_quality_by_group": _BY_GROUP,
    "monthly_quality_area_by_lot": f"""
select etapa2, categoria, mes, lote, calidad, coalesce(sum(m2), 0) / 10000 as area_aplicacion
from ({_MONTHLY.replace("area / 10000 as area_aplicacion", "area as m2")}) m
where mes is not null and lote is not null group by 1, 2, 3, 4, 5""",
    "monthly_quality_totals": _TOTALS,
    "monthly_quality_share": f"""
select *, 100 * conteo / sum(conteo) over (partition by etapa2, categoria, mes) as porcentaje
from ({_TOTALS}) t""",
    "monthly_quality_share_page": f"""
select mes, calidad, conteo, 100 * conteo / sum(conteo) over (partition by mes) as porcentaje
from ({_TOTALS}) t
where etapa2 = 'preforza' and categoria = 'nutricion' and year(mes) = 1999""",
    "group_list": """
select distinct descripcion as label, descripcion as value, etapa, fecha from (
  select descripcion, 'preforza' as etapa, fecha from grupossiembra
  union all select descripcion, 'preforza', fecha from grupos2dacosecha
  union all select descripcion, 'postforza', fecha from gruposforza
  union all select descripcion, 'postforza', fecha from gruposforza2
  union all select descripcion, 'semillero', fecha from grupossemillero) g""",
    "group_block_quality": _BLOCK_QUALITY,
    "group_table": f"""
select grupo, categoria, bloque, {_blank("fecha de siembra")}, {_blank("fecha de inducción")},
  {_blank("# de aplicaciones pendientes")}, {_blank("# de aplicaciones realizadas")},
  {_blank("# de aplicaciones realizadas tardías")},
  {_blank("# de aplicaciones realizadas adelantadas")}
from ({_BLOCK_QUALITY}) q""",
    # Half up to cents in whole numbers.
    "group_weights": """
select grupo_siembra, llave, fecha,
  (2 * cast(sum(valor) * 100 as bigint) + count(valor)) // (2 * count(valor)) / 100 as promedio
from pesoplanta
join (select distinct grupo_siembra, desarrollo || descripcion as k from blocks_desarrollo) b
  on b.k = llave
group by grupo_siembra, llave, fecha""",
    "group_applications": _ORDERS,
    "group_application_table": f"""
select * replace ({_spanish('"fecha aplicación"')} as "fecha aplicación") from ({_ORDERS}) o""",
    "weight_samples": "select llave, fecha, cast(valor as double) as valor from pesoplanta",
    "weight_distribution": """
select llave, fecha, count(valor) as muestras, cast(min(valor) as double) as minimo,
  quantile_cont(cast(valor as double), 0.25) as q1,
  quantile_cont(cast(valor as double), 0.5) as mediana,
  quantile_cont(cast(valor as double), 0.75) as q3,
  cast(max(valor) as double) as maximo, cast(sum(valor) as double) / count(valor) as promedio
from pesoplanta group by llave, fecha""",
    "weights_by_day": """
select llave, fecha, cast(sum(valor) as double) / count(valor) as peso_planta
from pesoplanta group by llave, fecha""",
    "last_weight_before_induction": _LAST_WEIGHT,
    "last_weight_co_located": _LAST_WEIGHT,
    "latest_weight_from_days": """
select llave, fecha as fecha_muestreo, cast(sum(valor) as double) / count(valor) as peso_planta
from pesoplanta group by llave, fecha
qualify row_number() over (partition by llave order by fecha desc nulls first) = 1""",
    "weight_quantiles_from_days": """
select llave, count(valor) as muestras, cast(min(valor) as double) as minimo,
  cast(quantile_disc(valor, 0.25) as double) as q1, cast(quantile_disc(valor, 0.5) as double) as mediana,
  cast(quantile_disc(valor, 0.75) as double) as q3, cast(max(valor) as double) as maximo
from pesoplanta where fecha between date '1998-07-01' and date '1999-06-30' group by llave having count(valor) > 0""",
    "weight_before_treatment": """
select a.bloque, a.codigo_cedula, a.etapa, a.categoria, a.fecha, w.fecha as fecha_muestreo, w.peso as peso_planta
from aplicaciones a asof left join (
  select llave, fecha, cast(sum(valor) as double) / count(valor) as peso from pesoplanta
  where fecha is not null group by llave, fecha) w
  on a.bloque = w.llave and a.fecha > w.fecha""",
    "block_list": """
select desarrollo || descripcion as label, desarrollo || blocknumber as value
from blocks_desarrollo""",
    "block_applications": _DONE,
    "block_applications_all": _DONE_ALL,
    "block_pending": _PENDING,
    "block_table": f"""
select * exclude (blocknumber, fecha, color, calificacion),
  {_spanish("fecha")} as "fecha ejecución"
from ({_DONE}) d""",
    "block_timeline": f"""
select *, {_spanish("fecha")} as fecha_str
from (select * from ({_DONE}) d union all by name select * from ({_PENDING}) p) b""",
    "block_timeline_all": f"""
select *, {_spanish("fecha")} as fecha_str
from (select * from ({_DONE_ALL}) d union all by name select * from ({_PENDING}) p) b""",
    "block_milestones": f"""
select bloque, etapa2, hito, fecha, hito || ': ' || {_spanish("fecha")} as texto from (
  select bloque, 'preforza' as etapa2, 'siembra' as hito, fecha_siembra as fecha
  from blocks_desarrollo
  union all select bloque, 'preforza', 'inducción', finduccion from blocks_desarrollo
  union all select bloque, 'postforza', 'inducción', finduccion from blocks_desarrollo
  union all select bloque, 'postforza', 'cosecha', mediana_fecha_cosecha from blocks_desarrollo) m
where fecha is not null""",
    "block_group_by_stage": """
select bloque, 'preforza' as etapa2, grupo_siembra as grupo from blocks_desarrollo
union all select bloque, 'postforza', grupo_forza from blocks_desarrollo
union all select bloque, 'semillero', grupo_semillero from blocks_desarrollo""",
    "lot_list": "select label, value from lotes_detalle",
    "lot_block_status": _status(),
    "fill_blank": _status("varchar"),
    "export_plain": """
select lote, bloque, coalesce(grupo_siembra, '') as "grupo de siembra",
  coalesce(grupo_forza, '') as "grupo de forza", coalesce(grupo_semillero, '') as "grupo semillero",
  coalesce(grupo_2da_cosecha, '') as "grupo inicio 2da",
  coalesce(grupo_forza2, '') as "grupo forza 2da",
  coalesce(cast(siembra as varchar), '') as siembra,
  coalesce(cast(finduccion as varchar), '') as "induccion pc", fecha_cosecha_pc as "cosecha 1ra",
  poda, coalesce(cast(deshija as varchar), '') as deshija,
  coalesce(cast(finduccion2 as varchar), '') as "induccion 2da",
  fecha_cosecha_sc as "cosecha 2da", semillerosegunda as "semillero 2da", barrido
from historia_bloques""",
    "markup_cells": """
select bloque, desarrollo || ' de ' || coalesce(grupo_siembra, '') || ' y ' || cast(fecha_siembra as varchar) as a,
  replace(descripcion, ' ', '_') || '* *' || bloque || '*' as b,
  descripcion || '  a_b_c' as c, '2 * 3 **' || descripcion || ' [sin fin' as d
from blocks_desarrollo""",
    "export_in_order": """
select row_number() over (order by lote nulls last, bloque nulls last) - 1 as orden, coalesce(lote, '') as lote,
  coalesce(bloque, '') as bloque, coalesce(grupo_siembra, '') as "grupo de siembra",
  coalesce(cast(siembra as varchar), '') as siembra
from historia_bloques""",
    "formula_list": "select codigo as label, codigo as value from formulas",
    "formula_inputs": """
select d.codigo as codigo_formula, d.insumo, a.nombre_insumo, d.categoria, d.cantha, d.descripcion
from formulas_det d left join agroinsumos a on trim(d.insumo) = trim(a.insumo)""",
    "alert_preforza": _PREFORZA,
    "alert_postforza": _POSTFORZA,
    "alert_semillero": _SEMILLERO,
    "alert_new_blocks": _NEW,
    "alert_preforza_list": _alert_list(_PREFORZA, "lote,"),
    "alert_postforza_list": _alert_list(_POSTFORZA, ""),
    "alert_semillero_list": _alert_list(_SEMILLERO, "lote,"),
    "alert_new_blocks_list": f"""
select * replace ({_spanish("fecha_siembra")} as fecha_siembra) from (
  select fecha_siembra, dias_sin_aplicacion, bloque, count(bloque) as veces from ({_NEW}) n group by all) g""",
    "current_group": _CURRENT,
    "weekly_program_rows": _program_rows(),
    "weekly_program_area": _PROGRAM_AREA,
    "sql_last_samples": """
select llave, fecha as fecha_muestreo, cast(sum(valor) as double) / count(valor) as peso_planta
from pesoplanta group by llave, fecha
qualify row_number() over (partition by llave order by fecha desc nulls first) = 1""",
    "sql_formula_inputs": """
select d.codigo as codigo_formula, d.insumo, a.nombre_insumo, d.categoria, d.cantha, d.descripcion
from formulas_det d left join agroinsumos a on trim(d.insumo) = trim(a.insumo)""",
    "sql_group_quality": """
select grupo, categoria, etapa2, bloque, cast(aplicaciones_pendientes as bigint) as pendientes,
  cast(num_aplicaciones_realizadas as bigint) as realizadas, cast(aplicaciones_con_retraso as bigint) as tardias,
  cast(aplicaciones_muy_proximas as bigint) as adelantadas
from calidad_aplicaciones where categoria = 'nutricion'""",
    "sql_new_blocks": _NEW,
    "sql_program_area": _PROGRAM_AREA,
    "sql_program_area_page": f"""
select * from ({_PROGRAM_AREA}) p where year(fecha) = 1999 and weekofyear(fecha) = 20""",
    "weekly_program": _program(),
    "weekly_program_page": _program("where year(fecha) = 1999 and weekofyear(fecha) = 20"),
    "forcing_candidates": _CANDIDATES,
    "forcing_table": f"""
select * replace ({_rounded("poblacion")}, {_rounded('"area neta (ha)"')}, {_rounded("densidad")},
  {_rounded('"edad actual meses"')}, {_rounded('"peso promedio ultimo muestreo"')})
from ({_CANDIDATES}) c""",
    "model_base": _MODEL_BASE,
    "features_pc": f"""
select * exclude (media, ancho, productividad_pc, recuperacion_pc, edad_inicio_sc)
from ({_FEATURES}) f where desarrollo = 'PC'""",
    "features_sc": f"""
select * exclude (media, ancho, dias_hasta_siembra_grupo)
from ({_FEATURES}) f where desarrollo = 'SC'""",
    "training_rows": _TRAINING,
    "projected_kilos": f"""
select *, prediccion * area as "kilos proyectados" from (
  select m.llave, paso as "Semanas adicionales", s.peso + 200 * paso as "peso forza proyectado", area,
    1.5::double + 0.5::double * coalesce((s.peso + 200 * paso) / 1000, 0)
      + 2 * coalesce(drenajes, 0) + 0.001::double * coalesce(media, 0)
      - 0.1::double * coalesce(datediff('day', m.fecha_siembra, {AS_OF} + dias) / 30, 0) as prediccion
  from ({_READY}) s join ({_MODEL_BASE}) m on m.llave = s.bloque
  left join {_RANGES} on m.rango_semilla = r.rango
  cross join (values (0, 0), (1, 7), (2, 15), (3, 21), (4, 29)) v(paso, dias)) p""",
    "forcing_scenarios_edited": f"""
select m.* exclude (finduccion, mean_fecha_cosecha, peso_forza), paso as "Semanas adicionales",
  peso as "peso forza proyectado", peso / 1000 as peso_forza,
  {AS_OF} + dias as finduccion, {AS_OF} + dias + 140 as mean_fecha_cosecha
from (select bloque, paso, dias, cast(2000 + 10 * length(bloque) + 150 * paso as double) as peso
  from blocks_desarrollo cross join (values (1, 7), (3, 21)) v(paso, dias)) e
join ({_MODEL_BASE}) m on m.llave = e.bloque""",
    "forcing_scenarios": f"""
select m.* exclude (finduccion, mean_fecha_cosecha, peso_forza), paso as "Semanas adicionales",
  r.peso + 200 * paso as "peso forza proyectado", (r.peso + 200 * paso) / 1000 as peso_forza,
  {AS_OF} + dias as finduccion, {AS_OF} + dias + 140 as mean_fecha_cosecha
from ({_READY}) r join ({_MODEL_BASE}) m on m.llave = r.bloque
cross join (values (0, 0), (1, 7), (2, 15), (3, 21), (4, 29)) v(paso, dias)""",
}

ORACLES = {name: with_binding(sql) for name, sql in _SQL.items()}
