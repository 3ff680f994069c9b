"""Sentences of three languages, labelled."""

EN = ["The queue waits before the next step is taken again.", "We decided to keep the old path because nothing else worked.", "Please note that the value was renamed last week.", "Nobody has touched this part since the build was changed."]
DE = ["Die Warteschlange wartet bevor der nächste Schritt beginnt.", "Wir behalten den alten Weg vorerst weil nichts anderes ging.", "Bitte beachte dass der Wert letzte Woche umbenannt wurde.", "Niemand hat diesen Teil angefasst seit das Abbild geändert wurde."]
RU = ["Очередь ждёт прежде чем начать следующий шаг.", "Мы пока оставляем старый путь потому что другого нет.", "Учти что значение переименовали на прошлой неделе.", "Никто не трогал эту часть с прошлой версии."]
SAMPLES = [(i, lang, t) for lang, texts in (("en", EN), ("de", DE), ("ru", RU)) for i, t in enumerate(texts)]
