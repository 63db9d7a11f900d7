"""Curated subject terms in English, German and Spanish.

Fixed values.  ``FIRM`` terms name the subject by themselves; ``LOOSE`` ones are everyday words as well and count
half and only in a document that has a firm term of the subject as well; a term listed under two subjects goes to the one with
more other evidence in the document.
"""

FIRM = {
    "science": "magnetometer genome hypothesis phylogeny enzyme neuron electron fossil spectrum isotope boson simulated orbit "
    "molecule epigenetics redshift photolysis chromatography catalyst sampled titrated sediment plasma centrifuge pipette "
    "sequenced calibrated petrology hipótesis átomo galaxia molécula experimento célula mikroskop galaxie zelle "
    "molekül enzym hypothese atom galaxy microscopio laboratorio telescopio fósil especie evolución versuch labor forscher "
    "proton quark physics chemistry biology astronomy laboratory gravedad energía elektron teleskop neutron quantum",
    "law": "witness clause notary warrant affidavit plaintiff sued ratified appeal verdict tenant probate judge lease statute "
    "injunction arbitration litigated overruled testified subpoena jurisdiction easement indemnified tort estoppel "
    "klage vertrag urteil berufung kündigung anwalt gericht zeuge richter gesetz fiscal juez testigo demanda contrato tribunal "
    "sentencia abogado lawsuit attorney defendant prosecutor litigation ley notario juicio notar mieter staatsanwalt",
    "sport": "penalty stadium racket referee coach tournament sprint peloton league goalkeeper outran wicket bogey qualified "
    "repechage backstroke dribbled crosscourt powerplay offside tackled scrum fartlek liga elfmeter torwart torneo turnier "
    "partido trainer estadio staffel stadion portero spiel gol entrenador carrera football tennis athlete rugby cricket "
    "mannschaft schiedsrichter árbitro equipo penalti tor lauf saison",
    "software": "server cluster compiler script database cache parser python endpoint compiled changelog webhook daemon linting "
    "repository bytecode mutex monorepo kernel idempotency merged sharding debugged deployed segfault refactored datenbank "
    "fehlersuche zweig schnittstelle quelltext biblioteca código rama consulta despliegue servidor depurador "
    "compilador bibliothek api refactoring backend frontend programmierer entwickler programa algoritmo algorithm programación",
    "health": "dosage nurse posture symptom therapy examined vaccine triage surgery orthotics hypertension rehabilitated glucose "
    "allergy diagnosed dermatologist tendonitis migraine insulin physician prescribed bandaged physiotherapy biopsy "
    "antihistamine vaccinated arrhythmia dosis puls impfung terapia cirugía klinik vacuna therapie allergie síntoma alergia "
    "médico arzt clínica hospital medicine patient enfermera paciente fiebre fieber schlaf pflege krankenhaus sueño doctor pulso",
    "finance": "dividend bond tax solvency loan pension remittance depreciation mortgage derivative arbitrage invested amortised "
    "overdraft liquidity escrow hedged portfolio refinanced brokerage annuity impuesto hypothek aktie zinsen factura kredit steuer "
    "pensión banco ahorro acciones rente rechnung préstamo hipoteca haushalt konto presupuesto inversión "
    "dividende bankkonto sparbuch interés",
    "travel": "museum roaming layover booking cruise jetlag island ferry beach backpacking sightseeing luggage timeshare airfare "
    "itinerary hostel border airport turnstile departed wandered toured boarded hitchhiked strand grenze flughafen herberge fähre "
    "gepäck reisepass playa museo frontera albergue pasaporte billete aeropuerto equipaje hotel tourist fahrkarte reise zug "
    "viaje isla crucero insel karte mapa",
    "cooking": "chopped oven skillet julienne braised roux umami pastry blanching sourdough sauce garlic brine spice "
    "proofing simmering flour onion whisk mirepoix broth dough kneaded marinated ganache horno harina cebolla sartén salsa "
    "masa caldo teig pfanne ofen brühe rezept mehl zwiebel soße receta cuisine kitchen knoblauch ajo gewürz especia sous vide",
    "music": "orchestra syncopation ostinato fermata pizzicato arpeggio rhythm album tempo choir drummer melody counterpoint bass "
    "tuned falsetto timbre capo rehearsed chord strummed harmonised improvised legato concert composed melodía acorde "
    "ritmo orquesta compás gitarre tonart takt akkord chor melodie coro symphony sonata piano orchester konzert "
    "concierto guitarra rhythmus probe ensayo canción",
    "education": "exam homework bursar thesis tutored grade classroom syllabus teacher scholarship learning memorised lectured "
    "semester school pedagogy graduated essay dissertation enrolled flashcards practicum rubric invigilator tutor "
    "matriculation numeracy maestra semestre tesis tarea examen vorlesung hausaufgabe stipendium diplom aufsatz universität "
    "schule lehrer lehrerin prüfung escuela alumno beca universidad clase aula unterricht seminararbeit klasse lección",
}
LOOSE = {
    "science": "telescope cell observed microscope",
    "law": "contract settlement charge hearing court party sentence",
    "sport": "match trained marathon season scored pitch court score run goal batter",
    "software": "release thread branch port patched memory code bug table",
    "health": "sleep pulse clinic cell operation charge",
    "finance": "market credit budget stock invoice share balance charge bank interest",
    "travel": "carry train map visa passport port ticket guide",
    "cooking": "batter seasoned recipe stock season",
    "music": "guitar violin pitch key scale score note",
    "education": "revised lecture seminar course degree",
}
