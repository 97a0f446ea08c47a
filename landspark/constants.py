"""Code lists, labels and limits of the domain."""

# ---------------------------------------------------------------------------------------------
# These have to equal the published rules of the source systems.
# ---------------------------------------------------------------------------------------------

COORDINATE_LIMIT = 100000.0
AXIS_LIMIT = -35.0
POINT_AXIS_LIMIT = -30.0

# (min lon, min lat, max lon, max lat)
MAINLAND_BOX = (-41.60, -9.60, -34.70, -7.20)
ISLAND_BOX = (-32.60, -4.00, -32.30, -3.70)
EVICTION_BOX = (-42.5, -10.5, -32.0, -3.0)

CLUSTER_EPS = 0.0001
CLUSTER_MIN_POINTS = 1

CASE_JITTER_KM = 0.8
EVICTION_JITTER_KM = 0.45
REGULARIZATION_JITTER_KM = 1.5
KM_PER_DEGREE = 111.0

TARGET_SUBJECTS = [
    11412, 11413, 10124, 11873, 12031, 10104, 15114, 3647,
    10094, 10100, 10434, 10444, 10445, 10446, 10451, 10453,
    10500, 10457, 10460, 10458, 10459, 7640, 3425, 5995, 10185, 9985,
]
TARGET_CLASSES = [91, 90, 96, 1707, 1709, 34, 49, 65, 63]

# category, subject codes, class codes, keywords; the first rule that holds wins
CASE_RULES = [
    ("Povos Indígenas & Territórios Quilombolas",
     [12031, 10104, 15114, 3647], [],
     ["quilombola", "indígena", "indio", "xucuru", "funai"]),
    ("Conflito Coletivo Rural & Agrário",
     [11412, 11413, 9985], [],
     ["conflito fundiário coletivo", "conflito agrário", "direito agrário"]),
    ("Reforma Agrária & Desapropriação",
     [10124, 11873, 5995, 10185], [91, 90],
     ["reforma agrária", "dívida agrária", "tda", "desapropriação"]),
    ("Terras Devolutas & Ações Discriminatórias",
     [10094, 10451, 10453, 10105], [96, 34],
     ["discriminatória", "terras devolutas", "demarcação"]),
    ("Reintegração e Conflito de Posse",
     [10100, 10434, 10444, 10445, 10446, 7640, 3425], [1707, 1709],
     ["reintegração", "esbulho", "turbação", "interdito proibitório", "imissão"]),
    ("Usucapião e Regularização de Posse",
     [10500, 10457, 10460, 10458, 10459], [49],
     ["usucapião"]),
]
OTHER_CATEGORY = "Outros Conflitos Fundiários"

# output column -> category it counts
CATEGORY_COLUMNS = {
    "total_posse": "Reintegração e Conflito de Posse",
    "total_reforma_agraria": "Reforma Agrária & Desapropriação",
    "total_indigena_quilombola": "Povos Indígenas & Territórios Quilombolas",
    "total_devolutas_discriminatoria": "Terras Devolutas & Ações Discriminatórias",
    "total_usucapiao": "Usucapião e Regularização de Posse",
    "total_coletivo_agrario": "Conflito Coletivo Rural & Agrário",
}

STATE_COURT = "TJPE"
FEDERAL_COURT = "TRF5"
STATE_JURISDICTION = "Comarca Estadual (TJPE)"
FEDERAL_JURISDICTION = "Subseção Federal (JFPE)"
FEDERAL_CASE_PATTERN = "%40583%"
STATE_CASE_URL = "https://pje.tjpe.jus.br/1g/ConsultaPublica/listView.seam"
FEDERAL_CASE_URL = "https://pje.trf5.jus.br/pje/ConsultaPublica/listView.seam"
MISSING_COURT = "Vara não informada"
STATE_NAME = "Pernambuco"
DEFAULT_CITY = (2611606, "Recife (JFPE)")
DEFAULT_SUBSECTION = "Recife (Sede)"
SEAT_LABEL = "Sede da Comarca"
DAUGHTER_LABEL = "Termo Judiciário (Município Abrangido)"

# last four digits of a federal case number -> (municipality code, name)
SUBSECTIONS = {
    "8300": (2611606, "Recife"),
    "8301": (2611606, "Recife"),
    "8302": (2611101, "Petrolina"),
    "8303": (2606002, "Garanhuns"),
    "8304": (2604106, "Caruaru"),
    "8305": (2611606, "Recife"),
    "8306": (2611606, "Recife"),
    "8307": (2610004, "Palmares"),
    "8308": (2613909, "Serra Talhada"),
    "8309": (2612208, "Salgueiro"),
    "8310": (2601102, "Arcoverde"),
    "8311": (2606200, "Goiana"),
    "8312": (2603801, "Carpina"),
    "8313": (2602902, "Cabo de Santo Agostinho"),
    "8314": (2607901, "Jaboatão dos Guararapes"),
    "8315": (2609907, "Ouricuri"),
    "0000": (2611606, "Recife (TRF5 Sede)"),
}

# federal court room -> subsection
ROOM_SUBSECTIONS = {
    1: "Recife (Sede)", 2: "Recife (Sede)", 3: "Recife (Sede)", 4: "Recife (Sede)",
    5: "Recife (Sede)", 6: "Recife (Sede)", 7: "Recife (Sede)", 8: "Petrolina",
    9: "Recife (Sede)", 10: "Recife (Sede)", 11: "Recife (Sede)", 12: "Recife (Sede)",
    13: "Recife (Sede)", 14: "Recife (Sede)", 15: "Recife (Sede)", 16: "Caruaru",
    17: "Petrolina", 18: "Serra Talhada", 19: "Recife (Sede)", 20: "Salgueiro",
    21: "Recife (Sede)", 22: "Recife (Sede)", 23: "Garanhuns", 24: "Caruaru",
    25: "Goiana", 26: "Palmares", 27: "Ouricuri", 28: "Arcoverde",
    29: "Jaboatão dos Guararapes", 30: "Jaboatão dos Guararapes", 31: "Caruaru",
    32: "Garanhuns", 33: "Recife (Sede)", 34: "Cabo de Santo Agostinho",
    35: "Cabo de Santo Agostinho", 36: "Recife (Sede)", 37: "Caruaru", 38: "Serra Talhada",
}

# municipality code, lon, lat, name; used where the gazetteer has no entry
FALLBACK_SEATS = [
    (2611606, -34.8770, -8.0578, "Recife"),
    (2607604, -34.8486, -7.7478, "Ilha de Itamaracá"),
    (2603454, -34.9819, -8.0205, "Camaragibe"),
    (2605459, -32.4297, -3.8576, "Fernando de Noronha"),
    (2602902, -35.0347, -8.2831, "Cabo de Santo Agostinho"),
    (2604106, -35.9711, -8.2833, "Caruaru"),
    (2611101, -40.5008, -9.3891, "Petrolina"),
    (2606002, -36.4928, -8.8907, "Garanhuns"),
    (2601102, -37.0583, -8.4192, "Arcoverde"),
    (2613909, -38.2981, -7.9914, "Serra Talhada"),
    (2612208, -39.1246, -8.0744, "Salgueiro"),
    (2609907, -40.0818, -7.8828, "Ouricuri"),
    (2606200, -35.0003, -7.5583, "Goiana"),
    (2603801, -35.2508, -7.8503, "Carpina"),
    (2610004, -35.5908, -8.6831, "Palmares"),
    (2607901, -35.0147, -8.1128, "Jaboatão dos Guararapes"),
    (2609600, -35.2975, -8.0089, "Olinda"),
    (2610707, -34.8728, -7.9408, "Paulista"),
    (2611002, -38.2197, -8.9792, "Petrolândia"),
    (2605707, -38.5689, -8.6014, "Floresta"),
    (2600203, -41.0094, -8.5147, "Afrânio"),
    (2605103, -37.6439, -8.0872, "Custódia"),
    (2614709, -36.2869, -8.2858, "Tacaimbó"),
    (2606507, -36.8550, -9.0469, "Iati"),
]

# spelling met in court documents -> spelling of the gazetteer, both normalised
NAME_ALIASES = {
    "iguaraci": "iguaracy",
    "sao caitano": "sao caetano",
    "palmerina": "palmeirina",
    "gloria de goita": "gloria do goita",
    "nova petrolandia": "petrolandia",
    "itamaraca": "ilha de itamaraca",
}
PROTECTED_NAME = "Abreu e Lima"

TITLE_PARTICLES = ["de", "da", "do", "das", "dos", "e"]
TAXONOMY_LABELS = {
    "ameaca": "Ameaça de Despejo",
    "remocao-parcial": "Remoção Parcial Executada",
    "remocao-total": "Despejo/Remoção Total Executada",
    "suspensao-temporaria": "Ordem de Despejo Suspensa Temporariamente",
    "suspensao-definitiva": "Despejo Suspenso Definitivamente / Conflito Sanado",
    "reintegracao-de-posse-violacao-da-posse-ou-propriedade-do-autor-do-processo":
        "Ação de Reintegração de Posse",
    "area-de-risco": "Alegação de Área de Risco Geológico/Hidrológico",
    "area-de-protecao-ambiental": "Conflito em Área de Proteção Ambiental",
    "impacto-de-obras-publicas-projetos-de-urbanizacao":
        "Impacto de Obras Públicas / Projetos de Urbanização",
    "violacao-de-contrato-de-locacao": "Inadimplência / Rescisão de Locação",
}
NOT_INFORMED = "Não informado"
DEFAULT_CAUSE = "Conflito Fundiário / Posse"

PRESSURE_LABELS = {
    "agriculture": "Agropecuária / Agricultura",
    "urban_expansion": "Expansão Urbana",
    "renewable_energy_project": "Energia Renovável (Eólica/Solar)",
    "natural_cause": "Causa Natural",
    "others": "Outros Vetores de Supressão",
}
MINING_LABEL = "Mineração"
TERRITORY_LABELS = {
    "tis_poligonais": "Terra Indígena (FUNAI)",
    "areas_de_quilombolas_pe": "Território Quilombola (INCRA)",
    "limiteucsfederais_a": "Unidade de Conservação (ICMBio)",
    "embargos_icmbio": "Área Embargada (ICMBio)",
}
TERRITORY_DEFAULT_LABEL = "Território"
# substring of the source name -> label; the first that occurs wins
PROPERTY_SOURCE_LABELS = [
    ("snci", "SNCI"), ("sigef", "SIGEF"), ("area_imovel", "CAR"), ("sicar", "CAR"),
]
PROPERTY_SOURCE_DEFAULT = "Imóvel"

# attribute, prefix put before it; the first attribute with a value gives the title
TITLE_ATTRIBUTES = [
    ("nome_imovel", ""), ("nome_area", ""), ("nome_imove", ""), ("no_projeto", ""),
    ("nome_uc", ""), ("nomeuc", ""), ("nm_fcu", ""), ("comunidade", ""), ("nome", ""),
    ("traditional_name", ""), ("numero_processo", "Processo CNJ "),
    ("processo", "Processo ANM "), ("cod_imovel", "CAR "), ("codigo_imo", "SIGEF "),
    ("alertcode", "Alerta #"), ("numero_ai", "Auto #"), ("numero_emb", "Embargo #"),
]
TITLE_ID_ATTRIBUTES = ["id", "objectid", "fid"]
TABLE_SKIPPED = ["geometry", "geom", "the_geom", "shape", "cor_hex", "id", "ogc_fid", "objectid"]
DEFAULT_FILL = "#3b82f6"
DEFAULT_STROKE = "#1d4ed8"
KML_NAMESPACE = "http://www.opengis.net/kml/2.2"

# layers from the one shown on top to the one at the bottom
LAYER_PRIORITY = [
    "land_overlaps_points", "processos_conflitos_judiciais", "despejo_zero_pe",
    "moradia_legal_processos_pe", "autos_infracao_icmbio", "car_casos_analisados",
    "sigef_casos_analisados", "moradia_legal_pe", "iterpe_glebas_pe", "iterpe_malha_posses_pe",
    "land_overlaps", "alerts_with_intersections", "car_with_alerts_and_intersections",
    "assentamentos_incra_pe", "ucs_estaduais_cprh_pe", "processos_minerarios_pe",
    "ibge_favelas_comunidades_pe", "tis_poligonais", "areas_de_quilombolas_pe",
    "embargos_icmbio", "limiteucsfederais_a", "sigef_privado_pe", "sigef_publico_pe",
    "imovel_certificado_snci_privado_pe", "imovel_certificado_snci_publico_pe", "area_imovel_1",
]
UNLISTED_PRIORITY = 999

# file, bound on the east edge of a part, below which the part is discarded
SPURIOUS_PARTS = {"gleba_saojoao_03_finalizada.kml": -38.0}
REGULARIZATION_KIND = "REURB / Regularização Fundiária"
REGULARIZATION_ORIGIN = "TJPE - Moradia Legal (NUREF)"
PARCEL_KIND = "Posse Rural / Agricultura Familiar"
PARCEL_ORIGIN = "ITERPE - Malha de Posses de Terras Devolutas"
PREFIX_RULES = [("IBIRA", "Ibirajuba")]
RECIFE = (2611606, -34.877, -8.0579, "Recife")
