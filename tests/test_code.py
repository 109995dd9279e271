"""Definitions and calls in code fences of the languages that are read from their tokens."""

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomdex.functions import code
from loomdex.operators import symbols
from loomdex.sources import markdown

CASES = {
    "javascript": (
        """// function no() {}
const total = 3, pattern = /fn(x) {/g;
async function* load(url) { return fetch(url, `x ${a} function q() {}`); }
const twice = async (n) => { return n * two(n); };
const half = function (n) { return n / 2; };
class Queue extends Base { constructor(x) { super(x); } push(item) { if (x) { go(1); } this.items.add(item); } static of() {} get size() { return 0; } }
export default function start() {}
""",
        "load:function twice:function half:function Queue:class Queue.push:method Queue.of:method Queue.size:method start:function",
        "fetch two go add",
    ),
    "ts": (
        """interface Shape { area: number }
type Key = string;
namespace Geo { export function dist(a: number): number { return abs(a); } }
abstract class Solid<T> { abstract volume(): number; protected scale(by: T): T { return by; } }
const pick = (x: number): number => x + 1;
""",
        "Shape:interface Geo.dist:function Solid:class Solid.volume:method Solid.scale:method pick:function",
        "abs",
    ),
    "tsx": ("export function Card({ title }: Props) { return <p>{title}</p>; }\nclass Page { render() { return <div />; } }", "Card:function Page:class Page.render:method", ""),
    "rust": (
        """pub const LIMIT: u8 = 1;
pub struct Store<'a> { name: &'a str }
impl<'a> Store<'a> { pub fn open(name: &'a str) -> Self { let c = '{'; Store { name } } fn close(&self) { drop(self.name.len()); } }
pub trait Flush { fn flush(&self); fn both(&self) { self.flush(); } }
impl Flush for Store<'_> { fn flush(&self) { println!("a {}", r#"fn x() {"#); } }
mod disk { pub fn sync() {} }
mod elsewhere;
macro_rules! log { () => {} }
fn main() { Store::open("x"); parse::<u8>("1"); }
""",
        "Store:class Store.open:method Store.close:method Flush:interface Flush.both:method Store.flush:method disk:module disk.sync:method log:macro main:function",
        "drop len flush println open parse",
    ),
    "golang": (
        """type Box struct { W int }
type (
  Small struct { A int }
  Namer interface { Name() string }
)
func (b *Box) Grow(n int) error { return grow(n) }
func (b Pair[K, V]) Area() int { return b.W }
func main() { fmt.Println(1); go func() { work() }() }
""",
        "Box:type Small:type Namer:type Box.Grow:method Pair.Area:method main:function",
        "grow Println work",
    ),
    "java": (
        """@Service("x")
public class Shop<T> extends Base implements Runnable {
  private final List<T> items = make();
  public Shop(int n) { super(n); }
  @Override public <R> List<R> sell(int n) throws IOException { if (n > 1) { return count(n); } return null; }
  static class Till { void ring() { new Bell().ding(); } }
  interface Payer { void pay(int n); }
}
""",
        "Shop:class Shop.sell:method Shop.Till:class Shop.Till.ring:method Shop.Payer:interface Shop.Payer.pay:method",
        "make count Bell ding",
    ),
    "c": (
        """#define F(x) struct q { x }
typedef struct pair { int a; } pair_t;
typedef int (*handler)(int);
union both { int i; float f; };
enum color { RED, BLUE };
struct pair *make(int a) { struct pair p; return wrap(a); }
int declared(int x);
static unsigned long add(int x, int y) { return x + y; }
""",
        "pair_t:type pair:class handler:type both:class color:type make:function add:function",
        "wrap",
    ),
    "c++": (
        """namespace net {
class Socket : public Base {
public:
  Socket(int port);
  ~Socket();
  bool send(const std::string& s) const;
};
Socket::Socket(int port) : fd_(port), n_(1) { open(port); }
bool Socket::send(const std::string& s) const { return write(s); }
enum class State { On, Off };
template <typename T> T clone(T v) { return v; }
}
int main() { net::Socket s(1); s.send("x"); }
""",
        "net.Socket:class net.Socket.Socket:method net.Socket.send:method net.Socket.Socket:method net.Socket.send:method net.State:type net.clone:function main:function",
        "open write send",
    ),
    "rb": (
        """# def no; end
module Shop
  class Cart < Base
    def initialize(n)
      @n = n if n
      while n > 1 do
        n -= 1
      end
    end
    def self.build = make(5)
    def empty?; end
    def each
      items.each do |x|
        yield(x) unless x.nil?
      end
    end
  end
  def self.open; end
end
def top; end
""",
        "Shop:module Shop.Cart:class Shop.Cart.initialize:method Shop.Cart.build:method Shop.Cart.empty?:method Shop.Cart.each:method Shop.open:method top:method",
        "make each nil?",
    ),
}


@pytest.mark.parametrize("lang", sorted(CASES))
def test_definitions_and_calls(lang):
    source, defined, called = CASES[lang]
    got = code.symbols(source, code.grammar(lang))
    assert [f"{n}:{k}" for n, k, _ in got[0]] == defined.split()
    assert [n for n, _ in got[1]] == called.split()
    assert [line for *_, line in got[0]] == sorted(line for *_, line in got[0])


def test_every_language_is_covered():
    assert {code.grammar(lang).language for lang in CASES} == set(code.GRAMMARS)
    assert code.grammar("toml") is None and code.grammar("") is None


@given(st.text(alphabet="abc(){}[]<>;:,.='\"`/\\#\n =fnclassdefend", max_size=300), st.sampled_from(sorted(code.GRAMMARS)))
def test_any_text_is_read(source, lang):
    defined, called = code.symbols(source, code.GRAMMARS[lang])
    lines = source.count("\n") + 1
    assert all(n and 1 <= line <= lines for n, _, line in defined) and all(n and 1 <= line <= lines for n, line in called)


@pytest.mark.parametrize("piece", ["struct a {", "a<", "class a ", "/[", 'r#"', "({["])
def test_code_that_closes_nothing_takes_no_long(piece):
    began = time.perf_counter()
    for lang in ("rust", "javascript"):
        defined, _ = code.symbols(piece * (60_000 // len(piece)), code.GRAMMARS[lang])
        assert all(len(n) <= 4 * code.DEPTH for n, _, _ in defined)
    assert time.perf_counter() - began < 20


def test_a_fence_over_the_limit_gives_nothing():
    assert code.symbols("fn a() {}\n" * (code.MOST_BYTES // 9), code.GRAMMARS["rust"]) == ([], [])


def test_fences_become_symbols_that_uses_resolve_to(spark):
    docs = spark.createDataFrame([("a.md", "# A\n\n```rs\nimpl Store {\n  fn open() {}\n}\n```\n"), ("b.md", "```rust\nfn main() { open(); }\n```\n"), ("c.md", "```toml\na = 1\n```"), ("d.md", None)], "path string, text string")
    found = symbols.extract(markdown.nodes(docs.filter("text is not null")))
    assert {(r.path, r.lang, r.name, r.kind, r.role, r.line) for r in found.filter("source = 'code_fence'").collect()} == {
        ("a.md", "rust", "Store.open", "method", "define", 5), ("b.md", "rust", "main", "function", "define", 2), ("b.md", "rust", "open", "call", "use", 2), ("c.md", "toml", "", "fence", "gap", 1),
    }
    edges = {(r.source, r.target, r.type) for r in symbols.symbol_edges(found).collect()}
    assert ("doc:b.md", "sym:rust:Store.open", "references") in edges
