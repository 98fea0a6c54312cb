"""Source texts that show the extraction rules, one file for each key ``{k}``, and folders and extensions of paths."""

#: The class is the first word after "class" in the file, even in a comment; a mapping names the next method
#: over other annotations, and is lost to any other line or with the method on its own line; package-private
#: methods are none; own calls and comments do not count, constructors do.
JAVA = """// this class handles{k} orders
@Service
public class Shop{k} {
  public Order load{k}(int id) {
    orderStore.fetch{k}(id); helper(); new Item{k}(); list.add(id);
    // audit.note{k}();
    return load{k}(id);
  }
  int hidden{k}() {
    gone.call();
  }
  private int quiet{k}() {
    orderStore.count{k}();
  }
  @GetMapping("/x")
  @Other
  private int shown{k}() {
  }
  @PostMapping("/y")
  int field;
  private int reset{k}() {
  }
  @PutMapping("/z") public int lost{k}() {
  }
  @Override public String name{k}() {
  }
}
"""

#: A route names the next function over comments; one of an attribute is none; private names are left out, dunders are
#: no entries; a signature that closes at its own indent ends the body; brackets in bases hide a class.
PYTHON = """import os
@app.get('/x')
# note
async def first{k}(a):
    user_store.load{k}(a)
    self.go{k}()
    helper{k}()
    Thing{k}()
    print(a)
    # gone.call()
    first{k}(a)
    a._quiet()
x = 1
@self.router.post('/y')
def second{k}():
    pass
def _hidden{k}():
    pass
class Shop{k}(Base):
    def __init__(self):
        pass
    def third{k}(self,
            a
    ):
        lost.call{k}()
class Odd{k}(Base(1)):
    def fourth{k}(self):
        stock.count{k}()
"""

#: Routes are entries by verb and path if the path is quoted; typed arrows, nameless functions, constructors and
#: members with a modifier are none; a decorator names the next declaration.
NODE = """router.get('/list{k}', h)
app.use(fn)
app.get(`/skipped`)
const first{k} = async (a) => {
  user_api.load{k}(a); helper{k}(); Thing(); this.gone();
}
const typed = (a): number => {
}
exports.lost = function () {}
const short{k} = a => stock.count{k}(a)
class Shop{k} {
  constructor() {
  }
  @Post()
  run{k}(a) {
    a.then();
    run{k}();
    this.x();
  }
  public never() {
  }
}
"""

CSHARP = """
using System;
namespace Shop{k}.Core;
// class Ghost { void M() { } }
public interface IStore{k} { Order{k} Load(int id); }
public class Base{k} { protected ILog _log; public void Note(string s) { } }
public class SqlStore{k} : Base{k}, IStore{k}
{
    public Order{k} Load(int id) { Note("x"); return new Order{k}(); }
}
public abstract class Half{k} : IStore{k} { public abstract Order{k} Load(int id); }
public class Desk{k} : Base{k}
{
    private readonly IStore{k} _store;
    public Helper{k} Tools { get; set; }
    public Desk{k}(IStore{k} store) { _store = store; _store.Load(0); }
    public void Run(Helper{k} h)
    {
        Order{k} o = this._store.Load(1);
        o.Pay(); h.Go(); Tools.Stop(); Helper{k}.Make(); base.Note("a{b"); Console.WriteLine("x"); Unknown.Call();
        new AddMigration{k}().Up();
    }
}
public class Helper{k} { public void Go() { } public void Stop() { } public static Helper{k} Make() { return null; } }
public class Order{k} { public void Pay() { } }
public class AddMigration{k} { public void Up() { } }
"""

FOLDERS = ["", "src/", "src/Node_Modules/x/", "Target/", "objects/", "a/.git/"]
EXTENSIONS = [".cs", ".JAVA", ".py", ".ts", ".txt", "", ".mjs"]
