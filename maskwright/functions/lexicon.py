"""Word lists that decide what is detected. Entries may be regular expressions."""

from __future__ import annotations

LEXICON = {
    "company_suffixes": [
        r"S\.L\.U\.", r"S\.A\.U\.", r"S\.Coop\.", r"S\.L\.", r"S\.A\.", "SLU", "SAU", "SCP", "SL", "SA", r"Inc\.", "Inc", r"Ltd\.", "Ltd",
        "LLC", "LLP", r"Corp\.", "Corp", "PLC", "GmbH", "AG", "mbH", "BV", "NV", "SAS", "SARL", "Lda", "Ltda", "Oy", "AB", "A/S", "Pty",
    ],
    "company_prefixes": [
        "Grupo", "Banco", "Fundación", "Asociación", "Universidade", "Universidad", "Instituto", "Consellería", "Ayuntamiento", "Concello",
    ],
    "name_particles": ["de la", "von der", "van der", "del", "de", "y", "du", "des", "le", "van", "von", "da", "do", "dos", "das"],
    "stopwords": [
        "Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo", "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
        "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre", "Hola", "Estimado", "Estimada", "Buenos", "Buenas", "Saludos",
        "Gracias", "Atentamente", "El", "La", "Los", "Las", "Un", "Una", "Por", "Para", "Cuando", "Aunque", "Además", "También", "Sin",
        "Pero", "Señor", "Señora", "Dear", "Hello", "Hi", "Regards", "Sincerely", "Best", "Thanks", "Yours",
    ],
    "titles": [
        "Psicólogo", "Psicóloga", "Médico", "Médica", "Abogado", "Abogada", "Ingeniero", "Ingeniera", "Graduado", "Graduada", "Licenciado",
        "Licenciada", "Trabajador Social", "Trabajadora Social", "Técnico", "Técnica", "Perito", "Colegiado", "Colegiada", "Director",
        "Directora", "Gerente", "Presidente", "Presidenta", "Secretario", "Secretaria", "Responsable", "Coordinador", "Coordinadora",
        "Administrador", "Administradora", "Apoderado", "Apoderada",
    ],
    "title_qualifiers": ["General", "Sanitaria", "Sanitario", "Clínica", "Clínico", "Forense", "Laboral", "Social", "Titular", "Superior"],
    "structure_heads": [
        "Informe", "Expediente", "Evaluación", "Evaluacion", "Anexo", "Apartado", "Página", "Pagina", "Asunto", "Fecha", "Referencia",
        "Documento", "Capítulo", "Capitulo", "Sección", "Seccion", "Apellidos", "Nombre", "Teléfono", "Telefono", "Dirección", "Direccion",
        "Correo", "Datos", "Resumen", "Conclusiones", "Antecedentes", "Observaciones", "Motivo", "Cliente", "Paciente", "Empresa",
        "Proyecto", "Factura", "Contrato", "Acta", "Solicitud", "Registro", "Título", "Titulo", "Tabla", "Figura", "Firma", "Psicológico",
        "Psicologico", "Psicológica", "Psicologica", "Clínico", "Clinico", "Clínica", "Clinica", "Final", "Anual", "Mensual", "Previo",
        "Subject", "Date", "From", "Name", "Phone", "Address", "Email", "Invoice", "Report", "Page", "Summary", "Notes", "Slide", "Client",
        "Patient", "Company", "Project", "Contract", "Reference", "Title", "Table", "Figure",
    ],
    "lettered_heads": [
        "Punto", "Opción", "Opcion", "Plan", "Artículo", "Articulo", "Cláusula", "Clausula", "Epígrafe", "Epigrafe", "Letra", "Grupo",
        "Tipo", "Modelo", "Nivel", "Fase", "Zona", "Bloque", "Parte", "Caso", "Según", "Segun", "Option", "Section", "Clause", "Article",
        "Item", "Point", "Appendix", "Annex",
    ],
    "honorifics": ["Dª", "Da", "Sra", "Srta", "Sr", "Dra", "Dr", "Lic", "Prof", "Mrs", "Mr", "Ms", "D"],
    "legal_heads": [
        "Ley Orgánica", "Real Decreto Legislativo", "Real Decreto", "Reglamento", "Directiva", "Convenio", "Convención", "Texto Refundido",
        "Estatuto", "Orden", "Resolución", "Sentencia", "Ley", "artículo", r"art\.", "Decreto Legislativo", r"Decreto(?!\p{L})",
        r"Código(?!\p{L})",
    ],
    "institutions": [
        "Tesorería General", "Seguridad Social", "Agencia Tributaria", "Hacienda", "INSS", "SEPE", "INEM", "Ministerio", "Consellería",
        "Consejería", "Ayuntamiento", "Diputación", "Junta", "Xunta", r"AEAT(?!\p{L})", r"TGSS(?!\p{L})", r"CNMV(?!\p{L})",
        r"DGT(?!\p{L})", r"CNMC(?!\p{L})", r"AEPD(?!\p{L})", "Complejo Hospitalario", "Centro de Salud", r"Departamento(?!\p{L})",
        r"Servicio(?!\p{L})", r"Hospital(?!\p{L})", r"Colegio(?!\p{L})", r"Escuela(?!\p{L})", r"Juzgado(?!\p{L})", r"Tribunal(?!\p{L})",
        r"Audiencia(?!\p{L})", r"Registro(?!\p{L})", r"Policía(?!\p{L})", "Guardia Civil", r"Fiscalía(?!\p{L})", r"Caja(?!\p{L})",
        r"Comunidad(?!\p{L})", r"CEIP(?!\p{L})", r"IES(?!\p{L})", r"CPI(?!\p{L})", r"SERGAS(?!\p{L})",
    ],
}
ACRONYM_EXCLUSIONS = [
    "IVA", "IRPF", "NIF", "CIF", "DNI", "NIE", "IBAN", "SEPA", "PDF", "URL", "API", "OK", "NDA", "SLA", "RGPD", "GDPR", "LOPD", "LOPDGDD",
    "BOE", "DOUE", "UE", "EU", "CEO", "CTO", "CFO", "COO", "RRHH", "HR", "KPI", "ONG", "SL", "SA", "SLU", "EUR", "USD", "GBP", "IT", "TI",
    "CRM", "ERP", "FAQ", "PYME", "PYMES", "TPV", "CP", "NB", "PS", "RE", "CC", "CCO", "ID", "PIN", "SMS", "USB", "WIFI",
]
#: Spanish localities that may follow a postcode.
LOCALITIES = [
    "A Coruña", "Alacant", "Alicante", "Almería", "Asturias", "Ávila", "Badajoz", "Baleares", "Barcelona", "Bizkaia", "Burgos", "Cáceres",
    "Cádiz", "Cantabria", "Castellón", "Ceuta", "Ciudad Real", "Córdoba", "Cuenca", "Girona", "Granada", "Guadalajara", "Guipúzcoa",
    "Huelva", "Huesca", "Jaén", "La Rioja", "León", "Lleida", "Lugo", "Madrid", "Málaga", "Melilla", "Murcia", "Navarra", "Ourense",
    "Palencia", "Pontevedra", "Salamanca", "Santa Cruz de Tenerife", "Segovia", "Sevilla", "Soria", "Tarragona", "Teruel", "Toledo",
    "Valencia", "Valladolid", "Zamora", "Zaragoza", "Andalucía", "Aragón", "Canarias", "Castilla-La Mancha", "Castilla y León", "Cataluña",
    "Comunidad de Madrid", "Comunidad Valenciana", "Extremadura", "Galicia", "País Vasco", "Región de Murcia", "Santiago de Compostela",
    "Vigo", "Ferrol", "Vilagarcía de Arousa", "Narón", "Oleiros", "Carballo", "Ribeira", "Redondela", "Ponteareas", "Marín", "Cangas",
    "Ames", "Culleredo", "Cambre", "Lalín", "Monforte de Lemos", "O Barco de Valdeorras", "Verín", "Xinzo de Limia",
]
#: Countries and large cities that are places in any text. A longer gazetteer is a parameter of the caller.
WORLD = [
    "Argentina", "Australia", "Austria", "Belgium", "Bolivia", "Brazil", "Bulgaria", "Canada", "Chile", "China", "Colombia", "Croatia",
    "Cuba", "Denmark", "Ecuador", "Egypt", "Finland", "France", "Georgia", "Germany", "Greece", "Hungary", "Iceland", "India", "Ireland",
    "Israel", "Italy", "Japan", "Jordan", "Kenya", "Malta", "Mexico", "Morocco", "Netherlands", "Norway", "Peru", "Poland", "Portugal",
    "Romania", "Russia", "Spain", "Sweden", "Switzerland", "Turkey", "Ukraine", "United Kingdom", "United States", "Uruguay", "Venezuela",
    "Alemania", "Brasil", "España", "Estados Unidos", "Francia", "Grecia", "Irlanda", "Italia", "México", "Países Bajos", "Reino Unido",
    "Suiza", "Amsterdam", "Athens", "Bangkok", "Beijing", "Berlin", "Boston", "Brussels", "Buenos Aires", "Chicago", "Copenhagen", "Dublin",
    "Edinburgh", "Geneva", "Hong Kong", "Istanbul", "Lisbon", "London", "Los Angeles", "Lyon", "Miami", "Milan", "Moscow", "Munich",
    "New York", "Oslo", "Paris", "Prague", "Rome", "San Francisco", "Santiago", "Seoul", "Shanghai", "Singapore", "Stockholm", "Sydney",
    "Tokyo", "Toronto", "Vienna", "Warsaw", "Washington", "Zurich",
]
PLACES = list(dict.fromkeys(WORLD + LOCALITIES))
#: Places that are names as well; they count after a geographic cue only.
AMBIGUOUS_PLACES = ["Chad", "Georgia", "Jordan", "Malta", "Marín", "Paris", "Rome", "Santiago", "Turkey", "Washington", "Victoria"]

