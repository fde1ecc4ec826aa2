"""Sentences that decline, sentences that only speak to the reader, and sentences on the matter, told by their words.

A softmax over hashed words, word pairs and character n-grams, fitted on the labelled rows below, which are invented for
this purpose, and on a bounded number of sentences from texts that are on the matter as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

FEATURES = 1 << 13
DECLINES, COURTESY, MATTER = 0, 1, 2

# Labelled rows, by language. - declines, ~ only speaks to the reader, + is on the matter.
ROWS = """
- I can't help with that request.
- I'm sorry, but I am unable to answer this.
- I must decline to solve this problem.
- This question will have to remain unanswered.
- That falls outside the topics I may discuss.
- I was not trained to talk about this subject.
- Providing a solution here would go against my guidelines.
- My policy does not permit me to respond to this.
- No solution will be given for this task.
- I won't be writing that program for you.
- This is not something I can assist with.
- I would rather leave this one alone.
- It is not possible for me to comply with this request.
- I have been instructed not to handle such tasks.
- I refuse to continue with this exercise.
- You will not get an answer to this from me.
- I do not feel comfortable answering this question.
- As an assistant I am not allowed to give out solutions.
- Helping with this is beyond what I am permitted to do.
- I'll have to pass on this one.
- Let us not go into this topic.
- I have no intention of answering that.
- Unfortunately there is nothing I can offer on this matter.
- This request cannot be fulfilled.
- I am going to stay silent about this.
~ Thank you for your question.
~ I understand that this matters to you.
~ I am sorry for the inconvenience.
~ Please ask a teacher or a friend instead.
~ I hope you understand.
~ Feel free to ask me something else.
~ You may want to look for help elsewhere.
~ I appreciate your patience.
~ That is an interesting question.
~ Perhaps someone else can point you to a good resource.
+ The array cannot be empty, so the first element always exists.
+ We cannot sort in place here, so we copy the list first.
+ The number must not exceed the limit.
+ If the stack is empty, print minus one and stop.
+ There is no solution when the sum is odd, so print NO.
+ I can't use recursion because the depth is too large, so I iterate.
+ The answer is forty two.
+ Sorry for the confusion above, the correct loop starts at one.
+ You are not allowed to visit a node twice, therefore keep a set.
+ The queue never holds more than n items.
+ Read the input and count how often each word occurs.
+ This runs in linear time and needs no extra memory.
+ It is impossible to reach the last cell if a wall blocks the row.
+ Return false when nothing matches.
+ The greedy choice does not work for negative weights.
+ Print the result without trailing blanks.
+ No such number exists.
+ Nothing is printed.
- No puedo ayudarte con eso.
- Lo siento, pero no me es posible responder a esta pregunta.
- Debo negarme a resolver este ejercicio.
- Esta consulta quedará sin respuesta.
- Eso queda fuera de los temas que puedo tratar.
- Mis normas me impiden dar una solución.
- No voy a escribir ese programa.
- No se me permite contestar este tipo de preguntas.
- Prefiero no entrar en este asunto.
- No daré ninguna solución para esta tarea.
- Me temo que no podré atender esta petición.
- Rechazo continuar con este tema.
~ Gracias por tu pregunta.
~ Espero que lo entiendas.
~ Siento las molestias.
~ Por favor, consulta a un profesor.
~ Puedes buscar ayuda en otro lugar.
+ La lista no puede estar vacía, así que existe el primer elemento.
+ No podemos ordenar aquí, por eso copiamos los datos.
+ Si no hay solución, imprime menos uno.
+ El resultado es la suma de los pares.
+ Recorre la cadena y cuenta las letras.
+ La respuesta es doce.
- Je ne peux pas vous aider avec cela.
- Désolé, il m'est impossible de répondre à cette question.
- Je dois refuser de résoudre ce problème.
- Cette question restera sans réponse.
- Cela sort des sujets que je peux aborder.
- Mes consignes m'interdisent de donner une solution.
- Je n'écrirai pas ce programme.
- Je ne suis pas autorisé à traiter ce genre de demande.
- Je préfère ne pas m'engager sur ce terrain.
- Aucune solution ne sera fournie pour cette tâche.
- Je crains de ne pas pouvoir donner suite à cette demande.
~ Merci pour votre question.
~ J'espère que vous comprendrez.
~ Veuillez consulter un enseignant.
~ Vous trouverez sans doute de l'aide ailleurs.
+ La liste ne peut pas être vide, donc le premier élément existe.
+ On ne peut pas trier sur place, on copie donc les données.
+ S'il n'y a pas de solution, on affiche moins un.
+ Le résultat est la somme des nombres pairs.
+ La réponse est douze.
- Dabei kann ich leider nicht helfen.
- Es tut mir leid, aber diese Frage kann ich nicht beantworten.
- Ich muss es ablehnen, diese Aufgabe zu lösen.
- Diese Frage wird unbeantwortet bleiben.
- Das liegt außerhalb der Themen, über die ich sprechen darf.
- Meine Richtlinien verbieten mir eine Antwort.
- Dieses Programm werde ich nicht schreiben.
- Dazu möchte ich mich nicht äußern.
- Zu dieser Aufgabe gebe ich keine Lösung heraus.
- Diesem Wunsch komme ich nicht nach.
- Ich bin nicht befugt, solche Anfragen zu bearbeiten.
- Hierzu bekommen Sie von mir keine Auskunft.
~ Danke für die Frage.
~ Ich hoffe auf Ihr Verständnis.
~ Bitte wenden Sie sich an eine Lehrkraft.
~ Vielleicht hilft Ihnen jemand anderes weiter.
+ Die Liste darf nicht leer sein, also gibt es ein erstes Element.
+ Hier kann man nicht sortieren, daher kopieren wir die Daten.
+ Gibt es keine Lösung, so gib minus eins aus.
+ Das Ergebnis ist die Summe der geraden Zahlen.
+ Die Antwort ist zwölf.
- Não posso ajudar com isso.
- Sinto muito, mas não consigo responder a esta pergunta.
- Devo recusar a resolução deste exercício.
- Esta pergunta ficará sem resposta.
- Isso está fora dos temas que posso tratar.
- As minhas regras impedem-me de dar uma solução.
- Não vou escrever esse programa.
- Não tenho permissão para responder a este tipo de pedido.
- Prefiro não entrar nesse assunto.
- Nenhuma solução será dada para esta tarefa.
~ Obrigado pela pergunta.
~ Espero que compreenda.
~ Por favor, consulte um professor.
+ A lista não pode estar vazia, logo existe o primeiro elemento.
+ Se não houver solução, imprima menos um.
+ O resultado é a soma dos números pares.
+ A resposta é doze.
- Я не могу помочь с этим.
- К сожалению, я не в состоянии ответить на этот вопрос.
- Вынужден отказаться от решения этой задачи.
- Этот вопрос останется без ответа.
- Это выходит за пределы тем, которые мне доступны.
- Правила запрещают мне давать решение.
- Эту программу я писать не буду.
- Мне не разрешено обсуждать такие темы.
- Предпочту не касаться этого.
- Решения этой задачи от меня не будет.
~ Спасибо за вопрос.
~ Надеюсь на понимание.
~ Пожалуйста, обратитесь к преподавателю.
+ Список не может быть пустым, поэтому первый элемент есть.
+ Если решения нет, выведите минус один.
+ Ответ равен сумме чётных чисел.
+ Ответ двенадцать.
- Nie mogę w tym pomóc.
- Przykro mi, ale nie jestem w stanie odpowiedzieć na to pytanie.
- Muszę odmówić rozwiązania tego zadania.
- To pytanie pozostanie bez odpowiedzi.
- To wykracza poza tematy, o których wolno mi mówić.
- Moje zasady zabraniają mi podania rozwiązania.
- Nie napiszę tego programu.
- Wolę nie wchodzić w ten temat.
- Nie podam żadnego rozwiązania.
~ Dziękuję za pytanie.
~ Mam nadzieję na zrozumienie.
~ Proszę zwrócić się do nauczyciela.
+ Lista nie może być pusta, więc pierwszy element istnieje.
+ Jeśli nie ma rozwiązania, wypisz minus jeden.
+ Wynik to suma liczb parzystych.
+ Odpowiedź to dwanaście.
+ Nie istnieje żadne rozwiązanie.
- 我无法帮助您处理这个请求。
- 很抱歉，我不能回答这个问题。
- 这个问题我只能拒绝。
- 此题恕不作答。
- 这超出了我可以讨论的范围。
- 我的规则不允许我给出解答。
- 我不会编写这个程序。
- 我选择不谈论这个话题。
- 对此我不提供任何答案。
~ 谢谢您的提问。
~ 希望您能理解。
~ 请向老师请教。
+ 列表不能为空，所以第一个元素一定存在。
+ 如果没有解，输出负一。
+ 结果是所有偶数之和。
+ 答案是十二。
+ 没有满足条件的数。
- Non posso aiutarti con questo.
- Mi dispiace, ma non sono in grado di rispondere a questa domanda.
- Devo rifiutarmi di risolvere questo esercizio.
- Questa domanda rimarrà senza risposta.
- Non scriverò questo programma.
- Le mie regole non mi permettono di dare una soluzione.
~ Grazie per la domanda.
~ Spero che tu capisca.
+ La lista non può essere vuota, quindi il primo elemento esiste.
+ La risposta è dodici.
+ Non c'è soluzione.
- Daar kan ik je niet mee helpen.
- Het spijt me, maar deze vraag kan ik niet beantwoorden.
- Ik moet weigeren deze opgave op te lossen.
- Deze vraag blijft onbeantwoord.
- Mijn regels staan geen oplossing toe.
~ Bedankt voor je vraag.
~ Ik hoop op je begrip.
+ De lijst kan niet leeg zijn, dus bestaat het eerste element.
+ Het antwoord is twaalf.
+ Er is geen oplossing.
- 申し訳ありませんが、お手伝いできません。
- その質問にはお答えできません。
- この課題の解答はお断りします。
~ ご質問ありがとうございます。
+ リストは空にできないので、最初の要素が必ずあります。
+ 答えは十二です。
- 죄송하지만 도와드릴 수 없습니다.
- 이 질문에는 답변할 수 없습니다.
~ 질문해 주셔서 감사합니다.
+ 목록은 비어 있을 수 없으므로 첫 원소가 있습니다.
+ 답은 열둘입니다.
"""

WORDS = re.compile(r"[぀-ヿ㐀-鿿가-힣]|[^\W\d_぀-ヿ㐀-鿿가-힣]+")
SHORT, LONG = 4, 40  # words; a shorter or longer sentence isn't taken for one that declines


def features(sentence: str) -> np.ndarray:
    """Hashes of the words, of pairs of words and of 3 to 5 characters of words with their ends."""
    w = WORDS.findall(sentence.lower().replace("’", "'"))
    out = {f"1{x}" for x in w} | {f"2{a} {b}" for a, b in zip(w, w[1:])} | {f"2{a} {b} {c}" for a, b, c in zip(w, w[1:], w[2:])}
    for x in w:
        s = f"<{x}>"
        out |= {s[k : k + n] for n in (3, 4, 5) for k in range(len(s) - n + 1)}
    return np.array(sorted({xxhash.xxh3_64_intdigest(f) % FEATURES for f in out}), np.int64)


class Speech:
    """What a sentence does: DECLINES, COURTESY or MATTER."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, rows: list[tuple[int, str]], rounds: int = 250, rate: float = 6.0, shrink: float = 2e-5) -> Speech:
        x = np.zeros((len(rows), FEATURES), np.float32)
        for k, (_, s) in enumerate(rows):
            f = features(s)
            x[k, f] = 1 / np.sqrt(max(1, len(f)))
        y = np.eye(3, dtype=np.float32)[[k for k, _ in rows]]
        each = y / y.sum(axis=0)  # kinds count alike, however many rows they have
        w, b = np.zeros((FEATURES, 3), np.float32), np.zeros(3, np.float32)
        for _ in range(rounds):
            z = x @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - y) * each.sum(axis=1, keepdims=True) / 3
            w -= rate * (x.T @ g + shrink * w)
            b -= rate * g.sum(axis=0)
        return cls(w, b)

    def kinds(self, sentence: str) -> np.ndarray:
        """Probabilities of DECLINES, COURTESY and MATTER."""
        f = features(sentence)
        if not SHORT <= len(WORDS.findall(sentence)) <= LONG:
            return np.array([0.0, 0.0, 1.0])
        z = self.weights[f].sum(axis=0) / np.sqrt(len(f)) + self.bias
        p = np.exp(z - z.max())
        return p / p.sum()


def labelled_rows() -> list[tuple[int, str]]:
    return [("-~+".index(line[0]), line[2:]) for line in ROWS.strip().splitlines()]


def speech(matter: Iterable[str] = (), most: int = 1000) -> Speech:
    """The model fitted on all rows, and on up to `most` sentences on the matter, those of the least hashes."""
    more = sorted({s.strip() for s in matter if 4 <= len(WORDS.findall(s)) <= LONG}, key=lambda s: xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")))
    return Speech.fit(labelled_rows() + [(MATTER, s) for s in more[:most]])
