-- Domain tables over the test tables, as defined in FIXTURES.md. Order matters.

CREATE OR REPLACE TEMP VIEW blocks AS
select concat(lpad(cast(p_partkey % 40 as string),2,'0'), lpad(cast(p_partkey as string),5,'0'), case when p_partkey % 17 = 0 then 'J' else '' end) as codigo, concat('L', lpad(cast(p_partkey % 40 as string),2,'0')) as lote, cast(p_size*250 as double) as area from part;

CREATE OR REPLACE TEMP VIEW blocks_detalle AS
select concat(lpad(cast(p_partkey % 40 as string),2,'0'), lpad(cast(p_partkey as string),5,'0'), case when p_partkey % 17 = 0 then 'J' else '' end) as blocknumber, concat(lpad(cast(p_partkey % 40 as string),2,'0'), lpad(cast(p_partkey as string),5,'0'), case when p_partkey % 17 = 0 then 'J' else '' end) as descripcion, cast(p_size*250 as double) as area, cast(p_partkey % 4 as double)/20 as drenajes, cast(p_size*(1300 + 20*(p_partkey % 21)) as double) as poblacion, cast(p_partkey % 30 as int) as dias_hasta_siembra_grupo, case p_partkey % 22 when 0 then 'CM COLINO MEDIO ENTRE 300-500 G' when 1 then 'CG COLINO GRANDE ENTRE 501-700 G' when 2 then 'RANGO 1 ( DE 300 A 700)' when 3 then 'RANGO 2 (DE 701 A 1000' when 4 then 'RANGO 3 (DE 1001 A 1500)' when 5 then 'R-1 (DE 250 A 550)' when 6 then 'R-2 (DE 551 A 900)' when 7 then 'RANG. 1 (DE 400 A 600)' when 8 then 'RANG. 2 (DE 601 A 900)' when 9 then 'RG. 1 (250 A 600)' when 10 then 'R-3 ( DE 901 A 1500)' when 11 then 'RANGO 2 (RAIZ)' when 12 then 'R.2 (601-900)' when 13 then 'R.3 (901-1200)' when 14 then 'R.1 (450-600)' when 15 then 'R.0 (250-450)' when 16 then 'R3: (601-900)' when 17 then 'R2: (451-600)' when 18 then 'R:4 (901-1200)' when 19 then 'R1: (250-450)' when 20 then 'SIN RANGO' end as rango_semilla from part;

CREATE OR REPLACE TEMP VIEW blocks_desarrollo AS
select concat(desarrollo, blocknumber) as bloque, blocknumber, desarrollo, blocknumber as descripcion, concat('GS', lpad(cast(k % 50 as string),2,'0')) as grupo_siembra, concat('GF', lpad(cast(k % 40 as string),2,'0')) as grupo_forza, concat('GE', lpad(cast(k % 30 as string),2,'0')) as grupo_semillero, fecha_siembra, case when k % 3 = 0 then null else fecha_siembra + 300 end as finduccion, case when k % 3 = 1 then fecha_siembra + 440 else null end as mediana_fecha_cosecha, cast(sz*(case when desarrollo = 'PC' then 700 + 60 * (k % 4) + 3 * (k % 30) else 600 + 150 * (k % 4) end) as double) as kilos_cosechados, cast(sz*(600 + 10*(k % 23)) as double) as frutas from (select p_partkey as k, p_size as sz, concat(lpad(cast(p_partkey % 40 as string),2,'0'), lpad(cast(p_partkey as string),5,'0'), case when p_partkey % 17 = 0 then 'J' else '' end) as blocknumber, desarrollo, case when desarrollo='PC' then date '1998-01-01' else date '1999-09-01' end + cast(p_partkey % 1200 as int) as fecha_siembra from part cross join (values ('PC'),('SC')) as d(desarrollo) where desarrollo='PC' or p_partkey % 2 = 0) as x;

CREATE OR REPLACE TEMP VIEW aplicaciones AS
select case when l_partkey % 11 = 0 then concat('ZZ', cast(l_partkey as string)) else concat(lpad(cast(l_partkey % 40 as string),2,'0'), lpad(cast(l_partkey as string),5,'0'), case when l_partkey % 17 = 0 then 'J' else '' end) end as blocknumber, concat(case when l_linestatus='F' or l_partkey % 2 = 1 then 'PC' else 'SC' end, case when l_partkey % 11 = 0 then concat('ZZ', cast(l_partkey as string)) else concat(lpad(cast(l_partkey % 40 as string),2,'0'), lpad(cast(l_partkey as string),5,'0'), case when l_partkey % 17 = 0 then 'J' else '' end) end) as bloque, case when l_suppkey % 13 = 0 then null else concat(case l_returnflag when 'A' then 'GS' when 'N' then 'GF' else 'GE' end, lpad(cast(l_suppkey % 50 as string),2,'0')) end as grupo, cast(l_shipdate as date) as fecha, cast(l_orderkey as string) as codigo_cedula, concat('F ', cast(l_suppkey % 25 as string)) as codigo_formula, concat('FORMULA ', cast(l_suppkey % 25 as string)) as descripcion_formula, case when l_quantity > 25 then 'PLAN' else null end as motivo, case when l_linenumber <= 4 then 'nutricion' when l_linenumber = 5 then 'proteccion' else 'herbicida' end as categoria, case l_returnflag when 'A' then case when l_linestatus='F' then 'Post Siembra' else 'Post Deshija' end when 'N' then case when l_linestatus='F' then 'Post Forza' else 'Post 2da Forza' end else 'Post Poda' end as etapa, case l_returnflag when 'A' then 'preforza' when 'N' then 'postforza' else 'semillero' end as etapa2, case when l_quantity % 7 = 6 then null else cast(l_quantity % 7 as int) end as calidad, cast(l_quantity as int) as dias_diferencia from lineitem;

CREATE OR REPLACE TEMP VIEW aplicaciones_pendientes AS
select bloque, blocknumber, grupo, fecha + 15 as fecha, categoria, etapa, etapa2 from aplicaciones;

CREATE OR REPLACE TEMP VIEW calidad_aplicaciones AS
select a.bloque, a.grupo, a.etapa2, a.categoria, min(b.fecha_siembra) as fecha_siembra, min(b.finduccion) as finduccion, count(*) as num_aplicaciones_realizadas, sum(case when calidad in (3,4) then 1 else 0 end) as aplicaciones_con_retraso, sum(case when calidad in (0,1) then 1 else 0 end) as aplicaciones_muy_proximas, sum(case when calidad is null then 1 else 0 end) as aplicaciones_pendientes from aplicaciones a left join blocks_desarrollo b on a.bloque=b.bloque group by a.bloque, a.grupo, a.etapa2, a.categoria;

CREATE OR REPLACE TEMP VIEW rangos_calidad_aplicaciones AS
select * from (values ('preforza','nutricion',15,3,4),('postforza','nutricion',12,2,3),('semillero','nutricion',20,4,5),('preforza','proteccion',30,5,6),('preforza','herbicida',60,9,9)) as t(etapa2, categoria, dias_entre_aplicaciones, tolerancia_rango_inferior, tolerancia_rango_superior);

CREATE OR REPLACE TEMP VIEW grupossiembra AS
select concat('GS', lpad(cast(s_suppkey % 48 as string),2,'0')) as descripcion, date '1998-01-01' + cast((s_suppkey % 48)*20 + (s_suppkey % 2)*0 as int) as fecha from supplier;

CREATE OR REPLACE TEMP VIEW grupos2dacosecha AS
select concat('GS', lpad(cast(s_suppkey % 45 as string),2,'0')) as descripcion, date '1998-01-01' + cast((s_suppkey % 45)*20 + (s_suppkey % 2)*3 as int) as fecha from supplier;

CREATE OR REPLACE TEMP VIEW gruposforza AS
select concat('GF', lpad(cast(s_suppkey % 40 as string),2,'0')) as descripcion, date '1998-01-01' + cast((s_suppkey % 40)*20 + (s_suppkey % 2)*0 as int) as fecha from supplier;

CREATE OR REPLACE TEMP VIEW gruposforza2 AS
select concat('GF', lpad(cast(s_suppkey % 35 as string),2,'0')) as descripcion, date '1998-01-01' + cast((s_suppkey % 35)*20 + (s_suppkey % 2)*0 as int) as fecha from supplier;

CREATE OR REPLACE TEMP VIEW grupossemillero AS
select concat('GE', lpad(cast(s_suppkey % 30 as string),2,'0')) as descripcion, date '1998-01-01' + cast((s_suppkey % 30)*20 + (s_suppkey % 2)*2 as int) as fecha from supplier;

CREATE OR REPLACE TEMP VIEW pesoplanta AS
select bloque as llave, fecha, cast(500 + dias_diferencia*50 as decimal(12,2)) as valor from aplicaciones;

CREATE OR REPLACE TEMP VIEW historia_bloques AS
select concat(lpad(cast(p_partkey % 40 as string),2,'0'), lpad(cast(p_partkey as string),5,'0'), case when p_partkey % 17 = 0 then 'J' else '' end) as bloque, concat('L', lpad(cast(p_partkey % 40 as string),2,'0')) as lote, case when p_partkey % 19 = 0 then null else concat('GS', lpad(cast(p_partkey % 50 as string),2,'0')) end as grupo_siembra, concat('GF', lpad(cast(p_partkey % 40 as string),2,'0')) as grupo_forza, case when p_partkey % 4 = 0 then concat('GE', lpad(cast(p_partkey % 30 as string),2,'0')) else null end as grupo_semillero, concat('GS', lpad(cast(p_partkey % 45 as string),2,'0')) as grupo_2da_cosecha, concat('GF', lpad(cast(p_partkey % 35 as string),2,'0')) as grupo_forza2, case when p_partkey % 23 = 0 then null else date '1998-01-01' + cast(p_partkey % 1200 as int) end as siembra, case when p_partkey % 5 >= 1 then date '1998-10-28' + cast(p_partkey % 1200 as int) else null end as finduccion, case when p_partkey % 5 >= 2 then date '1999-03-17' + cast(p_partkey % 1200 as int) else null end as fecha_cosecha_pc, case when p_partkey % 10 = 2 then date '1999-05-01' + cast(p_partkey % 1200 as int) else null end as poda, case when p_partkey % 5 >= 3 then date '1999-09-01' + cast(p_partkey % 1200 as int) else null end as deshija, case when p_partkey % 5 = 4 then date '2000-06-27' + cast(p_partkey % 1200 as int) else null end as finduccion2, cast(null as date) as fecha_cosecha_sc, cast(null as date) as semillerosegunda, cast(null as date) as barrido from part;

CREATE OR REPLACE TEMP VIEW programacionaplicaciones AS
select concat('FORMULA ', cast(l_suppkey % 25 as string)) as formula, case when l_partkey % 29 = 0 then concat('ZZ', cast(l_partkey as string)) else concat(lpad(cast(l_partkey % 40 as string),2,'0'), lpad(cast(l_partkey as string),5,'0'), case when l_partkey % 17 = 0 then 'J' else '' end) end as block, cast(l_shipdate as date) as fecha, cast(l_quantity*100 as double) as area, concat('F ', cast(l_suppkey % 25 as string)) as codformula from lineitem;

CREATE OR REPLACE TEMP VIEW lotes_detalle AS
select distinct lote as label, lote as value from blocks;

CREATE OR REPLACE TEMP VIEW formulas AS
select distinct concat('F ', cast(s_suppkey % 25 as string)) as codigo from supplier;

CREATE OR REPLACE TEMP VIEW formulas_det AS
select concat('F ', cast(p_partkey % 25 as string)) as codigo, concat(' ', p_brand, case when p_partkey % 2 = 0 then ' ' else '' end) as insumo, concat('FORMULA ', cast(p_partkey % 25 as string)) as descripcion, lower(p_type) as categoria, cast(p_size as double)/4 as cantha from part;

CREATE OR REPLACE TEMP VIEW agroinsumos AS
select distinct concat(case when p_brand = 'Brand#3' then 'Brand#?' else p_brand end, ' ') as insumo, concat('INSUMO ', p_brand) as nombre_insumo from part;

CREATE OR REPLACE TEMP VIEW cosecha_resumen AS
select bloque, blocknumber, desarrollo, kilos_cosechados, frutas from blocks_desarrollo where finduccion is not null and mediana_fecha_cosecha is not null;

CREATE OR REPLACE TEMP VIEW siembra AS
select blocknumber, cast(dias_hasta_siembra_grupo % 9 as string) as estado from blocks_detalle;
