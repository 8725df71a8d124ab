"""Word lists that results depend on.

Each list was measured on years of gazettes; they are data, not code, and every
function that uses one takes another list as a parameter.
"""

# Words that holders' names carry almost only in names of companies.
COMPANY_WORDS = frozenset((
    "ABOGADOS ACTIVOS ADVISORS ADVISORY AND ASESORAMIENTO ASESORES ASESORIA ASOCIADOS ASSESSORS ASSET ASSOCIATS "
    "AUDIT AUDITORES AUDITORIA AUDITORS AUREN BANCO BUSINESS CANARIAS CAPITAL CARTERA CENTER COMERCIAL CONCESIONES "
    "CONCURSAL CONSTRUCCIONES CONSULTING CONSULTORES CONSULTORIA CONSULTORS CONTROL CORPORACION CORPORATE "
    "CORPORATION CUENTAS DESARROLLOS DEVELOPMENT ECONOMISTAS EMPRESARIAL EMPRESAS ENERGIA ENERGIAS ENERGY EQUITY "
    "ERNST ESTATE ESTUDIOS EUROPA FILMS FINANCE FINANCIERA FINANCIEROS FINANZAS GABINETE GESTIO GESTION GLOBAL "
    "GRANT GREEN GROUP GRUP GRUPO HERMANOS HIJOS HOLDING HOLDINGS HOTELS IBERAUDIT IBERIA IBERICA INDUSTRIAL "
    "INFRAESTRUCTURAS INGENIERIA INMOBILIARIA INMOBILIARIAS INMOBILIARIO INMOBILIARIOS INMUEBLES INTEGRALES "
    "INTERNACIONAL INTERNATIONAL INVERSION INVERSIONES INVERSIONS INVEST INVESTMENT INVESTMENTS LEGAL LEVANTE "
    "MANAGEMENT MARITIMA MEDIA MEDITERRANEO NEGOCIOS NORTE OBRAS PARTICIPACIONES PARTNERS PATRIMONIAL PATRIMONIO "
    "PATRIMONIOS POWER PRODUCCIONES PROFESIONALES PROJECT PROMOCIONES PROMOTORA PROYECTOS RENOVABLES RENTA "
    "RESIDENCIAL SCR SERVEIS SERVICES SERVICIOS SGEIC SGIIC SIGLO SOLUCIONES SOLUTIONS SPAIN SUR TAX TECHNOLOGY "
    "TECNICAS THE TRANSPORTES TRIBUTARIOS VENTURE VENTURES XXI YOUNG "
).split())

# Street types and entrance words, which do not tell two addresses apart.
STREET_FILLER = frozenset((
    "AGUADULCE ALAM APARTADO APARTAMENTO ATICO AUTOV AVDA BAIXOS BAJO BAJOS BARDA BARRIADA BARRIO BIS BLOQUE BULEV "
    "BUNGALOW BUZON CABEZO CALA CALLE CAMPUS CASA CATASTRAL CENTER CENTRO CHALET CMNO CODIGO COMERCIAL COMPLEJO CON "
    "CONJUNTO CORREOS CRRIL CTRA DCHA DEPARTAMENTO DERECHA DESPACHO EDF EDIF EDIFICI EMPRESARIAL ENT ENTLO ENTREPLA "
    "ENTREPLANTA ENTRESUE ENTRESUELO ESC ESCALERA ESQUINA EXTERIOR GTA HOTEL IND INTERIOR IZDA IZQ IZQUIERDA "
    "IZQUIERDO LETRA LOC LOCA LOCAL LOCALES LONJA LUGAR MERCURIO MODULO MUELL MUTILVA NAVE NAVES NEGOCIOS OFICINA "
    "OFICINAS PABELLON PARC PARK PARQUE PARROQUIA PARTIDA PASEO PISO PLANTA PLAZA POLIG POLIGON PORTAL POSTAL "
    "POSTERIOR PQUE PRAJE PRIMERA PRIMERO PRINCIPAL PRTA PSAJE PTA PTDA PTL PTO PUEBLO PUERTA QUINTA RBLA "
    "REFERENCIA RESIDENCIAL SEGUNDA SEGUNDO SEMISOTANO SOTANO TIENDA TRVA URB URBANIZACION VIVIENDA ZONA "
).split())
