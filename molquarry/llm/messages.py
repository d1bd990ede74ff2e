"""A classifier of message templates, fitted on a bounded labelled sample.

Labels come from two sources: the example messages below, and mined templates that the labelling patterns
of ``residue`` recognise (or that stand in running text, for content). It is a multinomial naive Bayes
over words, pairs of words and word stems, so that messages in words no pattern names are recognised too.
"""

from __future__ import annotations

import math
from collections import Counter

# A small labelled sample of messages, by kind, one for each line.
EXAMPLES = {
    "error": """
        this content is not available at the moment
        this page isn't available right now
        the link you followed is broken
        the link may have expired or the page may be gone
        your account has been suspended
        account disabled
        this account is locked
        we are sorry, an error occurred
        an unexpected error has occurred, please try again
        something broke on our side
        the page you requested was not found
        the file you are looking for could not be found
        nothing was found at this location
        we couldn't load this page
        failed to load resource
        the site is down for maintenance
        we will be back soon, maintenance in progress
        the request has timed out
        connection timed out
        could not connect to the server
        the server is overloaded
        you are not authorized to view this page
        you must log in to view this content
        your request was blocked
        rate limit exceeded
        invalid request
        page introuvable
        la page demandée est introuvable
        une erreur est survenue, veuillez réessayer
        accès refusé
        ce contenu n'est plus disponible
        seite nicht gefunden
        ein fehler ist aufgetreten
        die datei konnte nicht geladen werden
        impossible de charger la page
        no se pudo cargar la página
        zugriff verweigert
        dieser inhalt ist nicht verfügbar
        página no encontrada
        se ha producido un error
        acceso denegado
        este contenido no está disponible
        找不到页面
        服务器错误
        访问被拒绝
    """,
    "script": """
        javascript must be enabled to view this page
        please allow javascript in order to continue
        permit scripts to proceed
        kindly allow ecmascript in this browser
        this application needs scripting to run
        you have scripting turned off
        enable scripts and reload to proceed
        your browser is blocking scripts
        javascript est désactivé, veuillez l'activer
        veuillez autoriser les scripts pour continuer
        javascript ist deaktiviert
        bitte erlauben sie skripte um fortzufahren
        javascript está desactivado
        por favor habilite javascript para continuar
        请开启脚本
    """,
    "filler": """
        insert text here
        insert copy here before publishing
        body copy goes here
        your text here
        your headline here
        add your content here
        write something here
        enter a title
        this is sample content
        dummy copy, to be replaced before launch
        copy to come
        text to follow
        content coming soon
        coming soon
        under construction
        this space intentionally left blank
        description goes here
        replace this text with your own
        votre texte ici
        insérez votre texte ici
        contenu à venir
        hier steht ihr text
        hier text einfügen
        inhalt folgt
        su texto aquí
        inserte aquí su texto
        próximamente
        在此输入文字
    """,
    "furniture": """
        all rights reserved
        terms of use and privacy policy
        back to top
        skip to main content
        go to the home page
        accept cookies
        we use cookies to improve your experience
        sign in or register
        contact us
        contact support if the problem persists
        share on social media
        subscribe to our newsletter
        previous page next page
        site map
    """,
    "content": """
        the sample was stirred for two hours and filtered
        the value was measured twice and agrees within the error
        we report the solubility of the compound in water
        the model reached a lower error on the test set
        the table lists the values for each compound
        the page of the notebook that lists the values is missing
        an error of this size is within the spread of the runs
        the server room is kept at a constant temperature
        the script that reads the file was written by a colleague
        the error of the fit was not found to depend on the size
        the content of water was not available for this lot
        insert the sample before the run and close the lid
        the connection between the ring and the chain is a single bond
        the account of the first run is given in the notes
        the link between the rings is broken by the acid
        der versuch wurde zweimal wiederholt
        die probe wurde filtriert und gewogen
        la muestra se disolvió en agua y se filtró
        l'échantillon a été dissous dans l'eau puis filtré
        样品溶于水后过滤
    """,
}
KINDS = tuple(EXAMPLES)
#: Pseudo-counts of a feature in a class, and how many mined templates the fit may see.
SMOOTH = 0.3
MOST_SAMPLE = 20_000


def features(toks: list[str]) -> list[str]:
    """Words, pairs of words and word beginnings; numbers, structures and wildcards say nothing."""
    out, before = [], ""
    for t in toks:
        w = t.strip(".,;:!?()[]{}\"'“”‘’»«…。！？，").replace("’", "'")
        if not any(c.isalpha() for c in w) or w.startswith("<"):
            before = ""
            continue
        if w.isascii():
            out.append(w)
            if len(w) > 5:
                out.append(w[:5] + "*")
                out.append("*" + w[-6:])
            if before:
                out.append(before + " " + w)
            before = w
        else:  # also languages that don't part words
            out.append(w)
            out.extend(w[i : i + 2] for i in range(len(w) - 1) if ord(w[i]) > 0x2E7F)
            if len(w) > 6 and ord(w[0]) < 0x2E80:
                out.append(w[:5] + "*")
            before = w
    return out


class Messages:
    """Log-odds of each kind against content, from class-wise feature counts."""

    def __init__(self, labelled: list[tuple[list[str], str]]):
        counts = {k: Counter() for k in KINDS}
        for kind, text in EXAMPLES.items():
            for line in text.split("\n"):
                counts[kind].update({f: 2 for f in features(line.split())})
        for toks, kind in labelled:
            counts[kind].update(set(features(toks)))
        whole = Counter()
        for c in counts.values():
            whole.update(c)
        n = {k: sum(c.values()) + SMOOTH * len(whole) for k, c in counts.items()}
        rest = {k: math.log(SMOOTH / n[k]) for k in KINDS}
        self.table = {f: {k: math.log((counts[k][f] + SMOOTH) / n[k]) - rest[k] for k in KINDS if counts[k][f]} for f in whole}
        self.rest = {k: rest[k] - rest["content"] for k in KINDS}

    def odds(self, toks: list[str]) -> tuple[str, float, float]:
        """(best kind but content, its log-odds against content a feature known, share of known features)."""
        seen = features(toks)
        known = [self.table[f] for f in seen if f in self.table]
        if not known:
            return "content", -1.0, 0.0
        base = sum(f.get("content", 0.0) for f in known)
        score = {k: sum(f.get(k, 0.0) for f in known) + self.rest[k] * len(known) - base for k in KINDS if k != "content"}
        kind = max(score, key=score.get)
        return kind, score[kind] / math.sqrt(len(known)), len(known) / len(seen)
