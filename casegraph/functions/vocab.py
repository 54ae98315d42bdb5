"""The controlled vocabulary: node and relation types, linkage rules, limits. Checked at import."""

from __future__ import annotations

from dataclasses import dataclass

# Names, weights, limits and state codes that records and results carry.
NODE_TYPES = (
    "REPORTE", "EVENTO", "PERSONA_MENCION", "IDENTIDAD", "CUENTA", "ALIAS", "ALIAS_PAGO", "EMAIL", "TELEFONO", "IP",
    "DISPOSITIVO", "EVIDENCIA", "HASH_PERCEPTUAL", "HUELLA_AUDIO", "SEGMENTO", "LUGAR_MENCION", "UBICACION",
    "JURISDICCION", "ORGANIZACION", "DOCUMENTO",
)
OBSERVED = (
    "REPORTADO_EN", "CONTIENE_EVENTO", "EMITIDO_POR", "USA_CUENTA", "ALIAS_DE", "ASOCIADO_A_TELEFONO",
    "ASOCIADO_A_EMAIL", "OBSERVADO_DESDE_IP", "USA_DISPOSITIVO", "PARTICIPA_EN", "ADJUNTA", "TIENE_HASH_PERCEPTUAL",
    "TIENE_HUELLA_AUDIO", "UBICADO_EN", "PUESTO_A_DISPOSICION_DE",
)
DERIVED = (
    "GEOLOCALIZA_EN", "ASIGNADA_A", "PERTENECE_A_JURISDICCION", "COINCIDE_CON", "POSIBLE_DUPLICADO_DE", "CONTRADICE",
    "RESPONDE_A", "IDENTIFICADO_COMO", "MENCIONA_TELEFONO", "MENCIONA_EMAIL", "MENCIONA_ALIAS", "MENCIONA_ALIAS_PAGO",
    "MENCIONA_LUGAR", "SIMILITUD_PERCEPTUAL", "COINCIDE_HUELLA_AUDIO",
)
INFERRED = ("POSIBLE_MISMA_IDENTIDAD", "SIMILAR_A")
ASSERTED = ("VINCULADO_POR_OPERADOR",)
FIRST_STATE = {"observada": "validada", "derivada": "pendiente", "inferida": "pendiente", "afirmada": "validada"}
DECISIONS = ("validada", "rechazada", "en_revision")
ARCHIVED = ("archivado", "archivado_latente", "pendiente")
ACTIVE = ("en_analisis", "en_investigacion", "derivado", "judicializado")
TRIGGERS = {
    "sin_datos_de_usuario": (("identificador_atribuible",), "alta"),
    "no_atribuible_nat": (("identificador_atribuible", "ip_atribuible"), "alta"),
    "sin_archivos": (("evidencia_con_hash",), "alta"),
    "sin_ubicacion": (("ubicacion_determinable", "ip_atribuible"), "media"),
    "material_sin_relevancia": (("caso_con_merito", "evidencia_con_hash"), "media"),
    "_default": (("identificador_atribuible", "evidencia_con_hash", "ip_atribuible", "caso_con_merito"), "media"),
}
PAIR_CAPS = {
    "CUENTA": 10000, "EVIDENCIA": 7500, "HASH_PERCEPTUAL": 5000, "HUELLA_AUDIO": 5000, "DISPOSITIVO": 5000, "TELEFONO": 5000,
    "EMAIL": 5000, "ALIAS_PAGO": 4000, "IP": 2500, "ALIAS": 1500, "UBICACION": 1000,
}
DEFAULT_CAP = 1000
ISP_HOURS = {"telecentro": 24, "telecom argentina": 24, "telefonica de argentina": 24, "claro": 12, "personal": 12, "movistar": 12}
DEFAULT_HOURS = 24
PROPOSE, PROBABLE, HIGH, CLUSTER, MOST = 0.55, 0.70, 0.90, 0.70, 0.99
FULL_DF, HUB_DF, LEAST_DISCRIMINANCE, CORPUS_MINIMUM, CORPUS_SHARE = 10, 50, 0.15, 200, 0.20
MERIT_PRIORITIES = ("1", "2")
#: Relations of structured fields whose identifiers individualise, and the kind of node that counts.
ATTRIBUTABLE = {"USA_CUENTA": "CUENTA", "USA_DISPOSITIVO": "DISPOSITIVO", "ASOCIADO_A_TELEFONO": "TELEFONO", "ASOCIADO_A_EMAIL": "EMAIL"}
CANDIDATE_KINDS = ("CUENTA", "DISPOSITIVO", "TELEFONO", "EMAIL", "EVIDENCIA", "IP", "ALIAS", "ALIAS_PAGO", "UBICACION", "HASH_PERCEPTUAL", "HUELLA_AUDIO")
COVERED = ("CUENTA", "ALIAS", "IP", "DISPOSITIVO", "TELEFONO", "EMAIL", "EVIDENCIA", "HASH_PERCEPTUAL", "HUELLA_AUDIO")
SENSITIVE = ("IP", "CUENTA", "TELEFONO", "EMAIL", "DISPOSITIVO", "ALIAS", "ALIAS_PAGO", "EVIDENCIA", "HASH_PERCEPTUAL", "HUELLA_AUDIO")
QUEUE_ROWS, REPORT_CENTRAL, CLI_ROWS = 40, 5, 25
TEXT_FACTOR, NAT_WITH_PORT, NAT_WITHOUT_PORT = 0.85, 0.85, 0.35
PLACE_WEIGHTS = {"estructura": 0.30, "rasgo": 0.25, "referencia": 0.25, "color": 0.12, "acceso": 0.08}
PLACE_ANCHORS = ("estructura", "rasgo", "referencia")
PLACES = {
    "estructura:deposito": ("estructura", ("galpon", "deposito", "almacen", "bodega", "tinglado")),
    "estructura:vivienda": ("estructura", ("casa", "vivienda", "departamento", "depto")),
    "rasgo:mural": ("rasgo", ("mural", "pared pintada", "grafiti", "graffiti")),
    "color:azul": ("color", ("azul", "celeste")),
    "color:rojo": ("color", ("rojo", "bordo", "colorado")),
    "referencia:estacion": ("referencia", ("estacion", "terminal de tren", "terminal ferroviaria")),
    "referencia:plaza": ("referencia", ("plaza", "parque", "plazoleta")),
    "acceso:lateral": ("acceso", ("entrada lateral", "puerta lateral", "acceso lateral")),
    "acceso:trasero": ("acceso", ("entrada trasera", "puerta trasera", "por atras")),
}
PLACE_SURE, IDENTITY_SURE, CONTRADICTION_SURE = 0.72, 0.85, 0.70
PLACE_LEAST, HAMMING_MOST, TRAVEL_KM, TRAVEL_KMH = 0.45, 8, 50.0, 900.0
TOP_CENTRAL, TOP_CANDIDATES, BETWEENNESS_NODES, PAGERANK_NODES = 10, 15, 3000, 20000


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    weight: float
    corroborates: bool
    discriminates: bool


# Rule, node type, weight, corroborates only, weakened by frequency.
RULES = tuple(
    Rule(*r)
    for r in (
        ("R01_CUENTA", "CUENTA", 0.98, False, False),
        ("R02_DISPOSITIVO", "DISPOSITIVO", 0.92, False, True),
        ("R03_TELEFONO", "TELEFONO", 0.90, False, True),
        ("R04_EMAIL", "EMAIL", 0.90, False, True),
        ("R05_EVIDENCIA", "EVIDENCIA", 0.88, False, True),
        ("R06_IP_VENTANA", "IP", 0.72, False, True),
        ("R07_IP_SUELTA", "IP", 0.28, True, True),
        ("R08_ALIAS", "ALIAS", 0.22, True, True),
        ("R09_UBICACION", "UBICACION", 0.08, True, True),
        ("R10_ALIAS_PAGO", "ALIAS_PAGO", 0.62, False, True),
        ("R11_PHASH_SIMILAR", "HASH_PERCEPTUAL", 0.82, False, False),
        ("R12_HUELLA_AUDIO", "HUELLA_AUDIO", 0.86, False, True),
        ("R13_CONTEXTO_LUGAR", "LUGAR_MENCION", 0.12, True, False),
    )
)
RULE = {r.name: r for r in RULES}
ORIGIN = {r: o for rs, o in ((OBSERVED, "observada"), (DERIVED, "derivada"), (INFERRED, "inferida"), (ASSERTED, "afirmada")) for r in rs}


def problems() -> list[str]:
    """What is wrong with the vocabulary: unknown types, weights out of range, corroborating rules that could propose."""
    out = [f"{r.name}: unknown node type {r.kind}" for r in RULES if r.kind not in NODE_TYPES]
    out += [f"{r.name}: weight {r.weight}" for r in RULES if not 0 < r.weight <= MOST]
    return out + [f"{r.name}: corroborates but reaches the threshold" for r in RULES if r.corroborates and r.weight >= PROPOSE]


if found := problems():
    raise ValueError("; ".join(found))
