"""Fixed values of back labels: the words and patterns by which their lines are told apart."""

from __future__ import annotations

import re

#: Words that head the list of ingredients, directions for use, and precautions.
INGREDIENTS = ("COMPOSICION INCI", "COMPOSICAO INCI", "INGREDIENTES", "INGREDIENTE", "INGREDIENTS", "INGREDIENTI", "INGREDIENT", "COMPOSICAO", "COMPOSITION", "COMPOSICION", "INCI")
USAGE = (
    "MODO DE USO", "MODO DE USAR", "MODO D USO", "ODO DE USO", "MODO DE EMPLEO", "INSTRUCOES DE USO", "INSTRUCOES PARA USO", "COMO USAR", "COMO UTILIZAR", "HOW TO USE",
    "DIRECTIONS FOR USE", "DIRECTIONS", "UTILIZACAO", "UTILIZACION",
)
PRECAUTIONS = ("PRECAUCOES", "PRECAUCAO", "PRECAUTIONS", "PRECAUTION", "CAUTIONS", "CUIDADOS", "CUIDADO", "ADVERTENCIAS", "ADVERTENCIA", "WARNINGS", "WARNING", "AVISOS")
#: Words that end the list of ingredients.
STOPS = (
    "LOT", "CONTEUDO", "PESO LIQUIDO", "VOLUME", "FABRICADO POR", "FABRICADO", "FABRICANTE", "MANUFACTURER", "MANUFACTURED BY", "MANUFACTURED", "PRODUZIDO POR", "PRODUZIDO", "MANUFACTURADO POR",
    "ELABORADO POR", "ELABORADO", "IMPORTADO POR", "IMPORTADO", "IMPORTADOR", "IMPORTED BY", "IMPORTED", "DISTRIBUIDO POR", "DISTRIBUIDO", "DISTRIBUIDORA", "DISTRIBUTOR", "DISTRIBUTED BY",
    "CNPJ", "CEP", "AUTFUNC", "AUT FUNC", "AUT. FUNC", "AUTORIZACAO", "REGISTRO ANVISA", "NUMERO DE REGISTRO", "PROCESSO ANVISA", "CODIGO DE BARRAS", "CODIGO EAN", "EAN", "GTIN",
    "LOTE", "LQTE", "L0TE", "BATCH", "VALIDADE", "VENCIMENTO", "EXPIRY", "MODO DE USO", "MODO DE USAR", "MODO DE EMPLEO", "INSTRUCOES DE USO", "COMO USAR", "COMO UTILIZAR", "HOW TO USE",
    "DIRECTIONS FOR USE", "PRECAUCOES", "PRECAUCAO", "PRECAUTIONS", "CAUTIONS", "CUIDADOS", "CUIDADO", "ADVERTENCIA", "ADVERTENCIAS", "WARNING", "WARNINGS", "SAC", "ATENDIMENTO AO CONSUMIDOR",
    "CENTRAL DE ATENDIMENTO", "WHATSAPP", "QUESTIONS", "QUESTION", "MAIL SUPPORT", "MAIL SUPOR", "CUSTOMER SERVICE", "CONTACT", "INDUSTRIA BRASILEIRA", "INDUSTRIA BRASILEIRO",
    "NDUSTRIA BRASILEIRA", "INDUSTRA BRASILEIRA", "INDUSTRIA BRASILENA", "PAIS DE ORIGEM", "MADE IN", "ORIGIN",
)
#: Words of lines about the maker, the batch and the shop.
ADMINISTRATION = (
    "CNPJ", "CEP", "AUTFUNC", "AUT FUNC", "AUTORIZACAO", "REGISTRO", "PROCESSO", "LOTE", "LQTE", "L0TE", "BATCH", "VALIDADE", "VENCIMENTO", "EXPIRY", "SAC", "ATENDIMENTO", "CONSUMIDOR", "WHATSAPP",
    "IMPORTADO", "DISTRIBUIDO", "FABRICADO", "INDUSTRIA BRASILEIRA", "INDUSTRIA", "SARGENTO", "RUA", "AVENIDA", "CALLE", "CARRERA", "PISO", "PAIS DE ORIGEM", "MADE IN", "WWW.", "HTTP", "HTTPS",
    "LTDA", "LTD", "S/A", "S A", "SAS", "SRL", "LLC", "INC", "CORP", "CORPORATION", "PLC", "GMBH", "EIRELI",
)
#: Words of claims, and of safety advice.
CLAIMS = (
    "VEGANO", "VEGAN", "VEGETARIANO", "VEGETARIAN", "CRUELTY FREE", "CRUELTY-FREE", "NAO TESTADO EM ANIMAIS", "NOT TESTED ON ANIMALS", "SEM PARABENOS", "PARABEN FREE", "SEM SILICONE",
    "SILICONE FREE", "SEM SULFATO", "SEM SULFATOS", "SULFATE FREE", "SEM FRAGRANCIA", "FRAGRANCE FREE", "SEM PERFUME", "SEM ALCOOL", "ALCOHOL FREE", "HIPOALERGENICO", "HYPOALLERGENIC",
    "DERMATOLOGICAMENTE TESTADO", "DERMATOLOGICAMENTE TESTADA", "DERMATOLOGICALLY TESTED", "OFTALMOLOGICAMENTE TESTADO", "CLINICAMENTE TESTADO", "CLINICALLY TESTED", "PH BALANCEADO",
    "PH BALANCED", "SEM GLUTEN", "GLUTEN FREE", "SEM OLEO MINERAL", "MINERAL OIL FREE", "SEM CORANTES", "DYE FREE", "SEM TALCO", "TALC FREE", "PROTECAO SOLAR", "RESISTENTE A AGUA",
    "WATER RESISTANT", "WATERPROOF", "PARA PELE SENSIVEL", "FOR SENSITIVE SKIN", "NATURAL", "NATURALE", "ORGANICO", "ORGANIC", "OIL FREE", "NAO COMEDOGENICO", "NON COMEDOGENIC",
    "TESTADO CLINICAMENTE",
)
SAFETY = (
    "NAO APLICAR", "NO APLICAR", "NO EXPONER", "PROTEGER", "PROTEJA", "EVITAR", "MANTER FORA", "FORA DO ALCANCE", "ALCANCE DE CRIANCAS", "ALCANCE DE LOS NINOS", "SE OCORRER",
    "SE OCORRER ALERGIA", "SE APARECER", "SINTOMAS DE IRRITACAO", "SINTOMAS DE IRRITACION", "IRRITACAO", "IRRITACION", "PRURIDO", "ALERGIA", "OLHOS", "OJOS", "FOGO", "LLAMA",
    "SUPERFICIES QUENTES", "SUPERFICIES CALIENTES", "CONTEUDO SOB PRESSAO", "CONTENIDO BAJO PRESION", "PODE EXPLODIR", "NO INCINERAR", "NAO INCINERAR", "PERIGO", "DANGER", "PELIGRO",
    "ATENCAO", "CAUTION", "WARNING",
)
#: Words that head warnings, and what makes safety advice one.
WARNED = ("WARNINGS", "WARNING", "ADVERTENCIAS", "ADVERTENCIA", "AVISOS", "DANGER", "PELIGRO")
GRAVE = "PRESSAO|PRESION|EXPLO|INCINER|FOGO|LLAMA|OLHOS|OJOS|DANGER|WARNING|PELIGRO"
#: Words before a maker's name, company forms, streets, and names of countries and signs of one.
MAKERS = (
    "FABRICADO POR", "FABRICADO", "FABRICANTE", "FABRICANT", "MANUFACTURER", "MANUFACTURED BY", "MANUFACTURED", "MADE BY", "PRODUZIDO POR", "PRODUZIDO", "MANUFACTURADO POR", "ELABORADO POR",
    "ELABORADO", "DISTRIBUTED BY",
)
FORMS = ("LTDA", "S A", "S/A", "SA", "SAS", "SRL", "S DE RL", "S DE R L", "LLC", "INC", "CORP", "CORPORATION", "PLC", "BV", "NV", "GMBH", "AG", "KG", "SPA", "S P A", "EIRELI", "ME", "LTD")
STREETS = ("RUA", "AVENIDA", "AV", "ALAMEDA", "TRAVESSA", "RODOVIA", "CALLE", "CARRERA", "JIRON", "BOULEVARD", "BLVD")
COUNTRIES = (
    "BRASIL", "BRAZIL", "ARGENTINA", "CHILE", "URUGUAI", "URUGUAY", "PARAGUAI", "PARAGUAY", "BOLIVIA", "PERU", "COLOMBIA", "EQUADOR", "ECUADOR", "MEXICO", "ESTADOS UNIDOS", "UNITED STATES",
    "USA", "CANADA", "FRANCA", "FRANCE", "ITALIA", "ITALY", "ALEMANHA", "GERMANY", "ESPANHA", "SPAIN", "PORTUGAL", "REINO UNIDO", "UNITED KINGDOM", "INDIA", "CHINA", "JAPAO", "JAPAN",
    "AUSTRALIA", "POLONIA", "POLAND", "TURQUIA", "TURKEY", "SUICA", "SWITZERLAND", "PAISES BAIXOS", "NETHERLANDS",
)
BRAZILIAN = ("INDUSTRIA BRASILEIRA", "INDUSTRIA BRASILEIRO", "NDUSTRIA BRASILEIRA", "INDUSTRA BRASILEIRA", "BRASILEIRAINDUSTRIA")
ORIGIN = ("MADE IN", "FABRICADO NO", "FABRICADO NA", "PAIS DE ORIGEM", "ORIGEM")
#: Codes of companies and postal codes, and telephone numbers.
CNPJ = "(?<!\\d)\\d{2}[ .-]?\\d{3}[ .-]?\\d{3}[/. -]?\\d{4}[- .]?\\d{2}(?!\\d)"
CEP = "(?<!\\d)\\d{5}[ .-]?\\d{3}(?!\\d)"
PHONE = "(?<!\\d)(?:\\+?\\d{1,3}[ .-]?)?(?:\\(?\\d{2}\\)?[ .-]?)?(?:9?\\d{4})[ .-]?\\d{4}(?!\\d)"
#: Most lines of a list, least characters before a stop counts, and most characters of texts.
MOST_LINES, LEAST_CONTENT, MOST_ADVICE, MOST_CLAIM, MOST_OTHER = 64, 5, 1400, 180, 2200
#: What ends a list for a while, after which it may go on.
INTERRUPTIONS = (
    "A[DO]VERTENCIAS?", "M[O0][D0][O0] DE US[O0]", "MODO DE USAR", "PROCURAR ORIENTACAO MEDICA", "NAO CONTEM CFC", "(?:MAIS|MAS) VENDIDO", "MERCADO DE DESODORANTES", "ALERGIA", "PRURIDO", "IRRITACAO",
    "VIDE FUNDO",
)
#: Stops that count before anything is gathered.
ALWAYS = (
    "CNPJ", "CEP", "AUTFUNC", "AUT FUNC", "AUTORIZACAO", "REGISTRO ANVISA", "NUMERO DE REGISTRO", "CODIGO DE BARRAS", "GTIN", "EAN", "LOTE", "BATCH", "VALIDADE", "VENCIMENTO", "SAC",
    "ATENDIMENTO AO CONSUMIDOR", "WHATSAPP",
)
#: Patterns of origins, addresses, companies, towns, registrations, contacts and sites.
ORIGINS = r"\b(?:HECHO EN|FEITO NO|MADE IN|FABRICADO NO|ORIGEM)\b"
ADDRESSES = r"\b(?:RUA|R\.?|AVENIDA|AV\.?|ALAMEDA|TRAVESSA|RODOVIA|CALLE|CARRERA|JIRON|BOULEVARD|BLVD)\b"
COMPANIES = r"\b(?:\p{L}[\p{L}0-9'&.-]+ ){1,4}(?:LTDA|LTD|S\.?A\.?|S/A|SA|SAS|SRL|LLC|INC|CORP|CORPORATION|PLC|BV|NV|GMBH|AG|KG|SPA|EIRELI|ME)\b"
TOWN = r"\b[A-Z]{3,}(?: [A-Z]{2,}){0,6} ?/ ?[A-Z]{2}\b"
COMPANY_NUMBER = r"(?<!\d)\d{2,4} ?/ ?[A-Z0-9]{3,8}"
REGISTRATION = r"\b(?:REGISTRO(?: ANVISA)?|REGISTRATION|PROCESSO(?: ANVISA)?|AUT\.? ?FUNC|AUTL?FUNC|AUTORIZACAO|NUMERO DE REGISTRO)\b"
REGISTERED = r"(?<![A-Z0-9])(?:2\s*\d{3,7}(?:\s+\d{1,3}(?:-[A-Z0-9]{1,8})?)?|2\s*\d{4,7}(?:-\d{1,4})?|\d{1,3}\.\d{3,7}(?:-\d{1,4})?)(?![A-Z0-9])"
CONTACTS = r"\b(?:QUESTIONS{0,2}|CONTACT|CUSTOMER SERVICE|ATENDIMENTO(?: AO CONSUMIDOR)?|MAIL SUPPORT|MAIL SUPOR|MAL SOPPORT|SOPPORT|SUPPORI|SUPPOR|E[- ]?MAIL).{0,180}?(?:@|MAIL|MAL|E[- ]?MAIL|SUPPORT|SOPPORT|SUPPORI|SUPPOR|CALL|PHONE|FONE)"
EMAIL = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
SITE = r"(?<![A-Z0-9@._-])(?:(?:HTTPS?://|WWW\.)[A-Z0-9][A-Z0-9.-]*|(?:[A-Z0-9](?:[A-Z0-9-]*[A-Z0-9])?\.)+(?:COM|ORG|NET|EDU|GOV|BR|PT|UK|US|FR|DE|IT|ES|EU))(?![A-Z0-9_-]|\.[A-Z])"
SITE_LABEL = r"\b(?:SITE|WEBSITE|ACESSE|VISITE|VISIT) ?:? ?$"
#: How many interruptions a list survives, and how many lines it is looked for after one and before its heading.
MOST_RECOVERIES, LOOK_AHEAD, LOOK_BACK = 2, 24, 6


def any_of(words: tuple[str, ...]) -> str:
    """A pattern for any of the words as whole words, longer ones first."""
    ordered = sorted(set(words), key=lambda w: (-len(w), w))
    return "(?<![A-Z0-9])(?:" + "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-") for w in ordered) + ")(?![A-Z0-9])"
#: Words before an importer's or a distributor's name, well-known companies, and what ends a company's name.
IMPORTERS = ("IMPORTADO POR", "IMPORTADOR", "IMPORTADO", "IMPORTED BY", "IMPORTED", "IMPORTADORA")
DISTRIBUTORS = ("DISTRIBUIDO POR", "DISTRIBUIDORA", "DISTRIBUTOR", "DISTRIBUTED BY")
CORPORATE = (
    "UNILEVER", "LOREAL", "L OREAL", "PROCTER", "COLGATE", "PALMOLIVE", "NIVEA", "BEIERSDORF", "JOHNSON", "RECKITT", "HENKEL", "KENVUE", "LVMH", "ESTEE LAUDER", "THE BODY SHOP", "NATURA",
    "BOTICARIO", "GRANADO", "CETAPHIL", "CERAVE", "EUCERIN", "DOVE", "REVLON", "MAYBELLINE", "RIMMEL", "COTY", "SHISEIDO",
)
NAME_ENDS = (
    " CNPJ", " CEP", " SAC", " AUTFUNC", " AUT FUNC", " REGISTRO", " LOTE", " CONTEUDO", " IMPORTADO POR", " IMPORTADO", " DISTRIBUIDO POR", " DISTRIBUIDORA", " INDUSTRIA BRASILEIRA",
    " PAIS DE ORIGEM", " WWW.", " HTTP", " AVENIDA", " RUA", " CALLE", " CARRERA", " PISO",
)
ABROAD = ("VITACURA", "MUNRO", "TEPALCAPA", "TULTITLAN", "ESTADO DE MEXICO")
FREE_CALL = r"(?<!\d)(?:0800|0300) ?\d{3,4}[ .-]?\d{4}(?!\d)"
#: How far an importer's and a distributor's zone reach before and behind a line, and the lengths of names.
IMPORT_ZONE, DISTRIBUTION_ZONE, LEAST_NAME, MOST_NAME, LEAST_LETTERS, COUNTRY_LINE = (5, 1), (3, 1), 5, 150, 6, 60
