"""Reports as SQL: table functions with named arguments over the domain tables.

    register(spark, tables)
    spark.sql("select * from programa_semanal(anio => :anio, semana => :semana)", args={"anio": 2021, "semana": 22})

Arguments are values, never pasted into a statement. One left out takes all rows. Spark expands a
function like a view and folds its arguments, so a bound argument is a filter of the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fieldspark.functions.rules import CHECK_GROUP
from fieldspark.sources.schemas import SCHEMAS
from fieldspark.sources.tables import Tables


@dataclass(frozen=True)
class Statement:
    arguments: str
    columns: str
    tables: tuple[str, ...]
    text: str


STATEMENTS = {
    # Samples of a block.
    "pesos": Statement(
        "de_bloque string default null",
        "llave string, fecha date, valor decimal(12,2)",
        ("pesoplanta",),
        "select llave, fecha, valor from {pesoplanta} where de_bloque is null or llave = de_bloque",
    ),
    # Last sampling day of each block.
    "ultimo_muestreo": Statement(
        "de_bloque string default null",
        "llave string, fecha_muestreo date, peso_planta double",
        ("pesoplanta",),
        """select llave, u.fecha, try_divide(cast(u.suma as double), cast(u.n as double))
from (
  select llave, max_by(struct(fecha, suma, n), coalesce(fecha, date'9999-12-31')) as u
  from (
    select llave, fecha, sum(valor) as suma, count(valor) as n from {pesoplanta}
    where de_bloque is null or llave = de_bloque group by llave, fecha)
  group by llave)""",
    ),
    # Inputs of a formula.
    "insumos_formula": Statement(
        "de_codigo string default null",
        "codigo_formula string, insumo string, nombre_insumo string, categoria string, cantha double, descripcion string",
        ("formulas_det", "agroinsumos"),
        """select d.codigo, d.insumo, a.nombre_insumo, d.categoria, d.cantha, d.descripcion
from {formulas_det} d left join {agroinsumos} a on trim(d.insumo) = trim(a.insumo)
where de_codigo is null or d.codigo = de_codigo""",
    ),
    # Counters of the blocks of a group.
    "calidad_grupo": Statement(
        "de_grupo string default null, de_categoria string default null",
        "grupo string, categoria string, etapa2 string, bloque string, pendientes bigint, realizadas bigint, tardias bigint, adelantadas bigint",
        ("calidad_aplicaciones",),
        """select grupo, categoria, etapa2, bloque, aplicaciones_pendientes, num_aplicaciones_realizadas,
  aplicaciones_con_retraso, aplicaciones_muy_proximas
from {calidad_aplicaciones}
where (de_grupo is null or grupo = de_grupo) and (de_categoria is null or categoria = de_categoria)""",
    ),
    # Planted blocks without any treatment. The anti join has the null rules of NOT IN.
    "bloques_nuevos": Statement(
        "hoy date",
        "bloque string, fecha_siembra date, dias_sin_aplicacion int",
        ("blocks_desarrollo", "aplicaciones"),
        """select d.bloque, d.fecha_siembra, datediff(hoy, d.fecha_siembra)
from {blocks_desarrollo} d left anti join {aplicaciones} a on d.bloque = a.bloque
where d.finduccion is null
  and (d.bloque is not null or not exists (select 1 from {aplicaciones}))
  and not exists (select 1 from {aplicaciones} where bloque is null)""",
    ),
    # Area of each order of a week: the calendar year and the ISO week number.
    "programa_semanal": Statement(
        "anio int default null, semana int default null",
        "fecha date, codformula string, formula string, grupo string, area decimal(38,2), entradas bigint",
        ("programacionaplicaciones", "historia_bloques"),
        """select p.fecha, p.codformula, p.formula, g.grupo, round(sum(p.area), 2), sum(p.entradas)
from (
  select fecha, codformula, formula, block, sum(cast(area as decimal(18,4))) as area, count(*) as entradas
  from (
    select distinct formula, block, fecha, area, codformula from {programacionaplicaciones}
    where (anio is null or (fecha >= make_date(anio, 1, 1) and fecha < make_date(anio + 1, 1, 1)))
      and (semana is null or weekofyear(fecha) = semana))
  group by fecha, codformula, formula, block) p
left join (
  select bloque, case when finduccion2 is not null then grupo_forza2
      when deshija is not null then grupo_2da_cosecha
      when poda is not null then grupo_semillero
      when finduccion is not null then grupo_forza
      when siembra is not null then grupo_siembra
      else '"""
        + CHECK_GROUP
        + """' end as grupo
  from {historia_bloques} where grupo_siembra is not null) g on g.bloque = p.block
group by p.fecha, p.codformula, p.formula, g.grupo""",
    ),
}


def register(spark: SparkSession, tables: Tables, prefix: str = "") -> None:
    """Makes the statements known to `spark` for this session, over views of `tables`. `prefix` goes before the names
    of functions and views."""
    for name in {n for s in STATEMENTS.values() for n in s.tables if n in SCHEMAS}:
        getattr(tables, name).createOrReplaceTempView(f"{prefix}{name}")
    for name, s in STATEMENTS.items():
        text = s.text.format(**{n: f"{prefix}{n}" for n in s.tables})
        spark.sql(
            f"create or replace temporary function {prefix}{name}({s.arguments}) returns table ({s.columns}) return {text}"
        )


def statement(spark: SparkSession, name: str, prefix: str = "", **arguments) -> DataFrame:
    """Rows of a registered statement for bound arguments."""
    if name not in STATEMENTS:
        raise ValueError(f"unknown statement {name}")
    known = {a.split()[0] for a in STATEMENTS[name].arguments.split(", ")}
    if unknown := set(arguments) - known:
        raise ValueError(f"{name} has no argument {sorted(unknown)}; it has {sorted(known)}")
    call = ", ".join(f"{a} => :{a}" for a in arguments)
    return spark.sql(f"select * from {prefix}{name}({call})", args=arguments)
