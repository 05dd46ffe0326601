"""Word lists, tables, patterns and thresholds that decide results.

They are facts of the task, not design: changing one changes what is reported.
"""

# --- fixed values: text ------------------------------------------------------------------
MOJIBAKE_MARKERS = ["Ã¡", "Ã©", "Ã­", "Ã³", "Ãº", "Ã±", "Ã‘", "Â¿", "Â°", "â€™", "â€œ", "ï¿½"]

# Broken sequence -> what was meant. Applied longest first, so that a bare lead byte never
# hides a longer sequence that starts with it.
MOJIBAKE_REPAIRS = {
    "Ã¡": "á", "Ã©": "é", "Ã­": "í", "Ã³": "ó", "Ãº": "ú", "Ã¼": "ü", "Ã±": "ñ", "Ã‘": "Ñ",
    "Ã‰": "É", "Ã“": "Ó", "Ãš": "Ú", "Ã": "Í",
    "Â¿": "¿", "Â¡": "¡", "Â°": "°", "Âº": "º", "Âª": "ª", "Â": "",
    "â€™": "'", "â€œ": "“", "â€“": "–", "â€”": "—", "â€¦": "…", "â€": "”", "ï¿½": "",
}

NULL_TOKENS = ["", "na", "n/a", "nan", "null", "none", "-", "--", "s/d", "nd"]
CURRENCY_PATTERN = r"(?iu)[$€£¥₡₱]|\b(?:mxn|usd|eur|pesos?|dlls?|dolares?)\b"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^[\d\s\-+().]{7,20}$"
BOOLEAN_TOKENS = [
    "si", "no", "s", "n", "true", "false", "verdadero", "falso", "yes", "1", "0",
    "activo", "inactivo", "vigente", "cancelado",
]

# --- fixed values: column names ----------------------------------------------------------
# Business role -> hints. The first role with a hit decides.
ROLE_HINTS = {
    "monetario": [
        "precio", "monto", "importe", "total", "subtotal", "venta", "ventas", "ingreso", "ingresos",
        "costo", "coste", "gasto", "pago", "saldo", "cargo", "abono", "utilidad", "margen", "comision",
        "salario", "sueldo", "factura", "ticket", "amount", "price", "revenue", "sales", "cost",
        "profit", "payment", "balance", "value", "valor", "iva", "descuento",
    ],
    "cantidad": [
        "cantidad", "cant", "unidades", "piezas", "pzas", "volumen", "stock", "existencia",
        "inventario", "qty", "quantity", "units", "count", "conteo", "num_", "numero_de",
    ],
    "fecha": [
        "fecha", "date", "dia", "mes", "anio", "ano", "periodo", "timestamp", "created", "alta",
        "baja", "vencimiento", "emision", "registro", "hora",
    ],
    "identificador": [
        "id", "folio", "clave", "cve", "codigo", "sku", "matricula", "rfc", "curp", "serie",
        "numero", "no", "num", "referencia", "uuid",
    ],
    "porcentaje": ["porcentaje", "pct", "percent", "tasa", "ratio", "%", "avance", "cumplimiento"],
    "geografia": [
        "estado", "ciudad", "municipio", "pais", "region", "zona", "sucursal", "codigo_postal",
        "cp", "colonia", "direccion", "state", "city", "country",
    ],
    "persona": [
        "cliente", "vendedor", "empleado", "usuario", "nombre", "contacto", "proveedor",
        "responsable", "agente", "customer", "user", "employee",
    ],
    "contacto": ["email", "correo", "mail", "telefono", "celular", "phone", "whatsapp"],
}
# A numeric column with such a name is a label, not a magnitude.
CODE_NAME_PATTERN = (
    r"(gtin|ean|upc|isbn|sku|barcode|codigo|código|clave|cve|folio|referencia|reference|serial|"
    r"numero_?de|postal|zip|^cp$|telefono|teléfono|phone|(^|[_\s])id([_\s]|$)|_id|id_)"
)
CODE_MEDIAN = 1e10

SLOTS = ["fecha", "ingreso", "costo", "cantidad", "cliente", "producto", "transaccion", "segmento", "estatus"]
INCOME_NAMES = ["importe", "total", "venta", "ingreso", "monto", "revenue", "amount", "sales"]
COST_NAMES = ["costo", "coste", "cost", "gasto", "compra"]
CLIENT_NAMES = ["client", "customer", "comprador"]
PRODUCT_NAMES = ["producto", "product", "sku", "articulo", "item"]
STATUS_NAMES = ["estatus", "status", "estado_"]
STATUS_EXACT_NAMES = ["estado", "estatus", "status"]
STATUS_MODES = ["pagad", "cancel", "activ", "pendien", "cerrad"]
NEGATIVE_STATUS = ["cancel", "rechaz", "devuel", "baja", "perdid", "no ", "fail"]
COUNTRY_NAMES = ["pais", "país", "country", "nacion", "nación"]

KPI_PRIORITY = [
    "Ingreso total", "Utilidad bruta", "Margen bruto", "Transacciones", "Ticket promedio",
    "Clientes únicos", "Unidades", "Registros", "Ingreso por cliente", "Productos distintos",
    "Costo total", "Precio promedio por unidad", "Ticket mediano", "Concentración top 10% clientes",
]

# --- fixed values: quality ---------------------------------------------------------------
SEVERITIES = ["crítico", "advertencia", "info"]
SEVERITY_WEIGHTS = {"crítico": 12.0, "advertencia": 5.0, "info": 1.5}

# --- fixed values: calendar --------------------------------------------------------------
MONTHS = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre",
    "octubre", "noviembre", "diciembre",
]
WEEKDAYS = ["lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"]

# --- fixed values: Mexican states --------------------------------------------------------
STATE_CENTRES = {
    "aguascalientes": (21.88, -102.29), "baja california": (30.47, -115.37),
    "baja california sur": (25.75, -111.75), "campeche": (18.85, -90.35),
    "chiapas": (16.50, -92.50), "chihuahua": (28.63, -106.07),
    "ciudad de mexico": (19.43, -99.13), "coahuila": (27.30, -102.05),
    "colima": (19.12, -103.87), "durango": (24.80, -104.75),
    "estado de mexico": (19.35, -99.63), "guanajuato": (20.92, -101.10),
    "guerrero": (17.55, -99.50), "hidalgo": (20.50, -98.75), "jalisco": (20.55, -103.55),
    "michoacan": (19.30, -101.70), "morelos": (18.75, -99.07), "nayarit": (21.75, -104.85),
    "nuevo leon": (25.60, -99.90), "oaxaca": (17.07, -96.72), "puebla": (19.05, -98.20),
    "queretaro": (20.72, -100.00), "quintana roo": (19.60, -88.05),
    "san luis potosi": (22.15, -100.98), "sinaloa": (25.00, -107.50), "sonora": (29.65, -110.65),
    "tabasco": (18.00, -92.90), "tamaulipas": (24.30, -98.65), "tlaxcala": (19.42, -98.20),
    "veracruz": (19.20, -96.35), "yucatan": (20.70, -89.10), "zacatecas": (23.15, -102.60),
}
STATE_ALIASES = {
    "cdmx": "ciudad de mexico", "df": "ciudad de mexico", "d f": "ciudad de mexico",
    "distrito federal": "ciudad de mexico", "mexico df": "ciudad de mexico",
    "ciudad de mexico cdmx": "ciudad de mexico",
    "mexico": "estado de mexico", "edomex": "estado de mexico", "edo de mexico": "estado de mexico",
    "edo mex": "estado de mexico", "estado mexico": "estado de mexico",
    "coahuila de zaragoza": "coahuila", "michoacan de ocampo": "michoacan",
    "veracruz de ignacio de la llave": "veracruz", "veracruz llave": "veracruz",
    "slp": "san luis potosi", "s l p": "san luis potosi", "nl": "nuevo leon", "n l": "nuevo leon",
    "bc": "baja california", "b c": "baja california", "bcn": "baja california",
    "bcs": "baja california sur", "b c s": "baja california sur",
    "qroo": "quintana roo", "q roo": "quintana roo", "qro": "queretaro",
    "queretaro de arteaga": "queretaro", "ags": "aguascalientes", "gto": "guanajuato",
    "jal": "jalisco", "chih": "chihuahua", "tamps": "tamaulipas", "yuc": "yucatan",
    "zac": "zacatecas", "son": "sonora", "sin": "sinaloa", "pue": "puebla", "ver": "veracruz",
    "oax": "oaxaca", "chis": "chiapas", "tab": "tabasco", "tlax": "tlaxcala", "mor": "morelos",
    "hgo": "hidalgo", "gro": "guerrero", "dgo": "durango", "col": "colima", "nay": "nayarit",
    "camp": "campeche", "mich": "michoacan",
}
# States whose display form is not just the key in title case.
STATE_DISPLAY = {
    "ciudad de mexico": "Ciudad de México", "estado de mexico": "Estado de México",
    "nuevo leon": "Nuevo León", "san luis potosi": "San Luis Potosí", "queretaro": "Querétaro",
    "michoacan": "Michoacán", "yucatan": "Yucatán",
}
