"""Word lists of each language, and their union for a profile.

Entries may be regular expressions. Languages extend each other where the lists say so; the pair of English and Spanish has the
lists of `lexicon.LEXICON`, which more languages join.
"""

from __future__ import annotations

from functools import lru_cache

from maskwright.functions.lexicon import ACRONYM_EXCLUSIONS, LEXICON

_NUMBERED = r"\p{Lu}\p{L}*|\d+(?:/(?:\d+|CE|UE))*"
BOTH = {
    **LEXICON,
    "acronym_exclusions": ACRONYM_EXCLUSIONS,
    "legal_continuation": [rf"(?:de|del|la|las|los|y|{_NUMBERED})"],
    "institution_continuation": [r"(?:de|del|la|las|los|\p{Lu}\p{L}*|\d+)"],
}


def _before(kind: str, word: str) -> list[str]:
    return BOTH[kind][: BOTH[kind].index(word)]


EN = {
    **BOTH,
    "company_suffixes": [r"Inc\.", "Inc", r"Ltd\.", "Ltd", "LLC", "LLP", r"Corp\.", "Corp", "PLC", "GmbH", "AG", "mbH", "BV", "NV", "SAS", "SARL", "Oy", "AB", "A/S", "Pty"],
    "company_prefixes": [],
    "name_particles": ["von der", "van der", "van", "von", "de la", "del", "de", "du", "des", "le"],
    "stopwords": ["Dear", "Hello", "Hi", "Regards", "Sincerely", "Best", "Thanks", "Yours", "The"],
    "titles": ["Manager", "Director", "Officer", "Engineer", "Assistant", "Coordinator", "Surveyor"],
    "structure_heads": BOTH["structure_heads"][BOTH["structure_heads"].index("Subject") :],
    "lettered_heads": BOTH["lettered_heads"][BOTH["lettered_heads"].index("Option") :],
    "honorifics": ["Mrs", "Mr", "Ms"],
    "legal_heads": [],
    "legal_continuation": [],
    "title_qualifiers": [],
    "institutions": [r"Department(?!\p{L})", r"Ministry(?!\p{L})", r"Council(?!\p{L})", r"Court(?!\p{L})", r"Hospital(?!\p{L})", r"University(?!\p{L})"],
    "institution_continuation": [r"(?:of|the|for|and|\p{Lu}\p{L}*)"],
}
ES = {
    **BOTH,
    "company_suffixes": [r"S\.L\.U\.", r"S\.A\.U\.", r"S\.Coop\.", r"S\.L\.", r"S\.A\.", "SLU", "SAU", "SCP", "SL", "SA", "Lda", "Ltda"],
    "name_particles": ["de la", "del", "de", "y", "da", "do", "dos", "das"],
    "stopwords": [*_before("stopwords", "Dear"), "Que", "Qué", "Primero", "Segundo", "Tercero", "Hechos", "Firmado"],
    "titles": [*BOTH["titles"], "Alcalde", "Alcaldesa", "Procurador", "Procuradora"],
    "structure_heads": _before("structure_heads", "Subject"),
    "lettered_heads": _before("lettered_heads", "Option"),
    "honorifics": ["Dª", "Da", "Sra", "Srta", "Sr", "Dra", "Dr", "Lic", "Prof", "D"],
}
GL = {
    **ES,
    "company_prefixes": [*ES["company_prefixes"], "Concello", "Xunta", "Consellería", "Deputación", "Universidade", "Fundación", "Asociación"],
    "name_particles": [*ES["name_particles"], "da", "do", "das", "dos", "de"],
    "stopwords": [
        *ES["stopwords"], "Que", "Ola", "Unha", "Pregamos", "Lembramos", "Comunicámoslles", "Atentamente", "Sen", "Segundo", "Durante", "Saúdos",
        "Grazas", "Bos", "Boas", "Días", "Luns", "Martes", "Mércores", "Xoves", "Venres", "Sábado", "Domingo", "Xaneiro", "Febreiro", "Marzo",
        "Abril", "Maio", "Xuño", "Xullo", "Agosto", "Setembro", "Outubro", "Novembro", "Decembro",
    ],
    "titles": [
        *ES["titles"], "Traballador Social", "Traballadora Social", "Xefe", "Xefa", "Avogado", "Avogada", "Enxeñeiro", "Enxeñeira", "Mestre",
        "Mestra", "Titor", "Titora", "Alcalde", "Alcaldesa", "Axente", "Procurador", "Procuradora",
    ],
    "structure_heads": [
        *ES["structure_heads"], "Enderezo", "Data", "Nome", "Apelidos", "Emisor", "Concepto", "Diagnóstico", "Revisión", "Comparecencia",
        "Asistentes", "Nota", "Asinado", "Expoñen", "Reunidos",
    ],
    "legal_heads": [
        "Lei Orgánica", "Real Decreto Lexislativo", "Decreto Lexislativo", r"Lei(?!\p{L})", r"Orde(?!\p{L})", r"Regulamento(?!\p{L})",
        "Estatuto de Autonomía", *ES["legal_heads"],
    ],
    "legal_continuation": [rf"(?:de|do|da|dos|das|del|la|las|los|e|y|{_NUMBERED})"],
    "institutions": [
        *ES["institutions"], "Complexo Hospitalario", "Centro de Saúde", r"Servizo(?!\p{L})", r"Servizos(?!\p{L})", r"Colexio(?!\p{L})",
        r"Escola(?!\p{L})", r"Xulgado(?!\p{L})", r"Rexistro(?!\p{L})", r"Caixa(?!\p{L})", r"Comunidade(?!\p{L})", "Valedora do Pobo",
    ],
    "institution_continuation": [r"(?:de|do|da|dos|das|del|la|las|los|e|\p{Lu}\p{L}*|\d+)"],
}
PT = {
    "company_suffixes": [r"S\.G\.P\.S\.", r"S\.A\.", r"Lda\.", "Unipessoal", "SGPS", "Lda", "CRL", "SA"],
    "company_prefixes": ["Grupo", "Banco", "Fundação", "Associação", "Universidade", "Instituto", "Câmara", "Junta", "Município", "Ministério"],
    "acronym_exclusions": [
        "NIF", "NIPC", "IRS", "IRC", "IVA", "RGPD", "CC", "AT", "IRN", "CNPD", "ACT", "IBAN", "SEPA", "PDF", "URL", "API", "OK", "NDA", "SLA", "UE",
        "CEO", "CTO", "CFO", "RH", "KPI", "ONG", "EUR", "PME", "CP", "ID", "PIN", "SMS", "USB",
    ],
    "name_particles": ["de", "da", "do", "das", "dos", "e"],
    "stopwords": [
        "Segunda", "Terça", "Quarta", "Quinta", "Sexta", "Sábado", "Domingo", "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho",
        "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro", "Olá", "Caro", "Cara", "Bom", "Boa", "Cumprimentos", "Obrigado", "Obrigada",
        "Atenciosamente", "O", "A", "Os", "As", "Um", "Uma", "Por", "Para", "Quando", "Embora", "Além", "Também", "Sem", "Mas", "Senhor", "Senhora",
    ],
    "titles": [
        "Psicólogo", "Psicóloga", "Médico", "Médica", "Advogado", "Advogada", "Engenheiro", "Engenheira", "Licenciado", "Licenciada", "Técnico",
        "Técnica", "Perito", "Diretor", "Diretora", "Gerente", "Presidente", "Secretário", "Secretária", "Responsável", "Coordenador",
        "Coordenadora", "Administrador", "Administradora", "Procurador", "Procuradora",
    ],
    "structure_heads": [
        "Relatório", "Processo", "Avaliação", "Anexo", "Ponto", "Página", "Assunto", "Data", "Referência", "Documento", "Capítulo", "Secção",
        "Seção", "Apelidos", "Nome", "Telefone", "Telemóvel", "Morada", "Endereço", "Correio", "Dados", "Resumo", "Conclusões", "Antecedentes",
        "Observações", "Motivo", "Cliente", "Paciente", "Empresa", "Projeto", "Projecto", "Fatura", "Factura", "Contrato", "Ata", "Pedido",
        "Registo", "Registro", "Título", "Tabela", "Figura", "Assinatura", "Final", "Anual", "Mensal",
    ],
    "lettered_heads": [
        "Ponto", "Opção", "Plano", "Artigo", "Cláusula", "Alínea", "Letra", "Grupo", "Tipo", "Modelo", "Nível", "Fase", "Zona", "Bloco", "Parte",
        "Caso", "Segundo",
    ],
    "honorifics": ["Sr", "Sra", "Srta", "Dr", "Dra", "Eng", "Engª", "Prof", "Profª", "Exmo", "Exma", "D"],
    "legal_heads": [
        "Lei Orgânica", "Decreto-Lei", "Decreto Regulamentar", "Regulamento", "Diretiva", "Convenção", "Estatuto", "Portaria", "Despacho",
        "Resolução", "Acórdão", "Sentença", "Lei", "artigo", r"art\.",
    ],
    "legal_continuation": [rf"(?:de|do|da|dos|das|e|{_NUMBERED})"],
    "title_qualifiers": ["Geral", "Sanitário", "Clínico", "Forense", "Laboral", "Social", "Titular", "Superior"],
    "institutions": [
        "Segurança Social", "Autoridade Tributária", "Finanças", "Ministério", "Câmara Municipal", "Junta de Freguesia", "Governo", "Tribunal",
        r"AT(?!\p{L})", r"IRN(?!\p{L})", r"CNPD(?!\p{L})", r"ACT(?!\p{L})",
    ],
    "institution_continuation": [r"(?:de|do|da|dos|das|\p{Lu}\p{L}*|\d+)"],
}
CA = {
    "company_suffixes": [r"S\.L\.U\.", r"S\.C\.C\.L\.", r"S\.Coop\.", r"S\.L\.", r"S\.A\.", "SCCL", "SLU", "SL", "SA"],
    "company_prefixes": [
        "Grup", "Banc", "Fundació", "Associació", "Universitat", "Institut", "Ajuntament", "Generalitat", "Diputació", "Consell", "Departament",
        "Conselleria",
    ],
    "acronym_exclusions": [
        "IVA", "IRPF", "NIF", "CIF", "DNI", "NIE", "IBAN", "SEPA", "PDF", "URL", "API", "OK", "NDA", "SLA", "RGPD", "GDPR", "LOPD", "DOGC", "BOE",
        "UE", "EU", "CEO", "CTO", "CFO", "RRHH", "KPI", "ONG", "SL", "SA", "EUR", "PIME", "CP", "ID", "PIN", "SMS", "USB",
    ],
    "name_particles": ["de la", "de les", "dels", "del", "de", "des", "i"],
    "stopwords": [
        "Dilluns", "Dimarts", "Dimecres", "Dijous", "Divendres", "Dissabte", "Diumenge", "Gener", "Febrer", "Març", "Abril", "Maig", "Juny",
        "Juliol", "Agost", "Setembre", "Octubre", "Novembre", "Desembre", "Hola", "Estimat", "Estimada", "Benvolgut", "Benvolguda", "Bon", "Bona",
        "Salutacions", "Gràcies", "Atentament", "Cordialment", "El", "La", "Els", "Les", "Un", "Una", "Per", "Quan", "Tot", "També", "Sense",
        "Però", "Senyor", "Senyora",
    ],
    "titles": [
        "Psicòleg", "Psicòloga", "Metge", "Metgessa", "Advocat", "Advocada", "Enginyer", "Enginyera", "Graduat", "Graduada", "Llicenciat",
        "Llicenciada", "Treballador Social", "Treballadora Social", "Tècnic", "Tècnica", "Perit", "Col·legiat", "Col·legiada", "Director",
        "Directora", "Gerent", "President", "Presidenta", "Secretari", "Secretària", "Responsable", "Coordinador", "Coordinadora",
        "Administrador", "Administradora", "Apoderat", "Apoderada",
    ],
    "structure_heads": [
        "Informe", "Expedient", "Avaluació", "Annex", "Apartat", "Pàgina", "Assumpte", "Data", "Referència", "Document", "Capítol", "Secció",
        "Cognoms", "Nom", "Telèfon", "Adreça", "Correu", "Dades", "Resum", "Conclusions", "Antecedents", "Observacions", "Motiu", "Client",
        "Pacient", "Empresa", "Projecte", "Factura", "Contracte", "Acta", "Sol·licitud", "Registre", "Títol", "Taula", "Figura", "Signatura",
        "Final", "Anual", "Mensual",
    ],
    "lettered_heads": [
        "Punt", "Opció", "Pla", "Article", "Clàusula", "Epígraf", "Lletra", "Grup", "Tipus", "Model", "Nivell", "Fase", "Zona", "Bloc", "Part",
        "Cas", "Segons",
    ],
    "honorifics": ["Sr", "Sra", "Srta", "Dr", "Dra", "Prof", "Hble", "Mn"],
    "legal_heads": [
        "Llei Orgànica", "Reial Decret Legislatiu", "Reial Decret", "Decret", "Reglament", "Directiva", "Conveni", "Estatut", "Ordre",
        "Resolució", "Sentència", "Llei", "article", r"art\.",
    ],
    "legal_continuation": [rf"(?:de|del|la|les|els|i|{_NUMBERED})"],
    "title_qualifiers": ["General", "Sanitària", "Sanitari", "Clínica", "Clínic", "Forense", "Laboral", "Social", "Titular", "Superior"],
    "institutions": [
        "Tresoreria General", "Seguretat Social", "Agència Tributària", "Hisenda", "Ministeri", "Conselleria", "Departament", "Ajuntament",
        "Diputació", "Generalitat", "Parlament", r"AEAT(?!\p{L})", r"TGSS(?!\p{L})", r"AEPD(?!\p{L})",
    ],
    "institution_continuation": [r"(?:de|del|la|les|els|\p{Lu}\p{L}*|\d+)"],
}
EU = {
    "company_suffixes": [
        r"S\.Koop\.", r"S\.L\.", r"S\.A\.", "Kooperatiba", "Fundazioa", "Elkartea", "Unibertsitatea", "Aldundia", "Udala", "Saila", "Taldea",
        "SL", "SA",
    ],
    "company_prefixes": ["Eusko", "Fundazio", "Elkarte", "Banku"],
    "acronym_exclusions": [
        "IVA", "IRPF", "NIF", "DNI", "NAN", "IFZ", "IBAN", "SEPA", "PDF", "URL", "API", "OK", "NDA", "SLA", "RGPD", "LOPD", "EHAA", "BOE", "EB",
        "UE", "EU", "CEO", "ONG", "EUR", "ID", "PIN", "SMS", "USB",
    ],
    "name_particles": ["de", "del", "de la", "y", "eta"],
    "stopwords": [
        "Astelehena", "Asteartea", "Asteazkena", "Osteguna", "Ostirala", "Larunbata", "Igandea", "Urtarrila", "Otsaila", "Martxoa", "Apirila",
        "Maiatza", "Ekaina", "Uztaila", "Abuztua", "Iraila", "Urria", "Azaroa", "Abendua", "Kaixo", "Agur", "Egun", "Arratsalde", "Gau",
        "Eskerrik", "Adeitasunez", "Agurtzen", "Eta", "Baina", "Ere", "Edo", "Hau", "Hori", "Hura",
    ],
    "titles": [
        "Psikologoa", "Medikua", "Abokatua", "Ingeniaria", "Graduatua", "Lizentziatua", "Gizarte Langilea", "Teknikaria", "Zuzendaria",
        "Kudeatzailea", "Lehendakaria", "Idazkaria", "Arduraduna", "Koordinatzailea", "Administratzailea",
    ],
    "structure_heads": [
        "Txostena", "Espedientea", "Ebaluazioa", "Eranskina", "Atala", "Orrialdea", "Gaia", "Data", "Erreferentzia", "Dokumentua", "Kapitulua",
        "Abizenak", "Izena", "Telefonoa", "Helbidea", "Posta", "Datuak", "Laburpena", "Ondorioak", "Aurrekariak", "Oharrak", "Arrazoia",
        "Bezeroa", "Pazientea", "Enpresa", "Proiektua", "Faktura", "Kontratua", "Akta", "Eskaera", "Erregistroa", "Izenburua", "Taula", "Irudia",
        "Sinadura",
    ],
    "lettered_heads": [
        "Puntua", "Aukera", "Plana", "Artikulua", "Klausula", "Letra", "Taldea", "Mota", "Eredua", "Maila", "Fasea", "Eremua", "Blokea", "Zatia",
        "Kasua",
    ],
    "honorifics": ["Jn", "And", "Dr", "Dra", "Prof", "Sr", "Sra"],
    "legal_heads": [
        "Lege Organikoa", "Errege Dekretua", "Dekretua", "Araudia", "Zuzentaraua", "Hitzarmena", "Estatutua", "Agindua", "Ebazpena", "Epaia",
        "Legea", "artikulua", r"art\.",
    ],
    "legal_continuation": [rf"(?:{_NUMBERED})"],
    "title_qualifiers": ["Orokorra", "Sanitarioa", "Klinikoa", "Forentsea", "Soziala", "Titularra"],
    "institutions": ["Gizarte Segurantza", "Zerga Agentzia", "Ogasuna", "Ministerioa", "Eusko Jaurlaritza", "Legebiltzarra", "Ertzaintza"],
    "institution_continuation": [r"(?:\p{Lu}\p{L}*|\d+)"],
}
PACKS = {"ca": CA, "en": EN, "es": ES, "eu": EU, "gl": GL, "pt": PT}
#: The languages that bring in a country's rules by themselves.
COUNTRY_LANGUAGES = {"ES": ("es", "gl", "ca", "eu"), "PT": ("pt",)}
#: The categories that a newly chosen country switches on.
COUNTRY_CATEGORIES = {
    "ES": ("DNI", "NIE", "INVALID_ID", "MASKED_ID", "ID_CODE", "PHONE", "ADDRESS"),
    "PT": ("NIF", "CARTAO_CIDADAO", "PHONE", "ADDRESS"),
}


@lru_cache(maxsize=64)
def lexicon_of(languages: tuple[str, ...]) -> dict[str, tuple[str, ...]] | None:
    """The lists of all packed languages together, each word once; None where no language has a pack."""
    chosen = sorted({x for x in languages if x in PACKS})
    if not chosen:
        return None
    if chosen == ["en", "es"]:
        lists = [BOTH]
    else:
        lists = [*([BOTH] if {"en", "es"} <= set(chosen) else []), *(PACKS[x] for x in chosen)]
    return {kind: tuple(dict.fromkeys(word for one in lists for word in one[kind])) for kind in BOTH}
